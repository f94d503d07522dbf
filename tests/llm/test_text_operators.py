"""Operators on texts against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sedge.llm import decontaminate, mixing, pii
from sedge.llm.common import Scratch
from sedge.llm.decontaminate import drop_contaminated, find_items, with_matches
from sedge.llm.line_dedup import dedup_lines
from sedge.llm.mixing import emitted, mix
from sedge.llm.ngram_join import Rule, join_documents, keep_one
from sedge.llm.queries import tokenizer_path
from sedge.llm.token_counts import PieceCounter, count_tokens
from sedge.llm.token_files import TokenEncoder, digests, read_index, read_tokens, write_tokens

SCHEMA = "doc_id long, text string, size long, matches string, key string, line int, w int, source string"
ODD = "aBcÄéñß 'sTl.,!?#$%12²½µªº\n\t\r\x0b日本語ſİΣς́̈ﬁ 　 ​🎉<|>_-ādž\x1c▁"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source), with other columns whose names operators use inside."""
    return spark.createDataFrame([(r[0], r[1], 7, "x", "k", 1, 2, r[2] if len(r) > 2 else "s") for r in rows], SCHEMA).repartition(3)


def words(r, n, most=400):
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


# ---- n-gram join ----------------------------------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[n : n + min(k, len(w))]) for n in range(len(w) - min(k, len(w)) + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed=1):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = words(r, r.randint(3, 120)).split()
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(1000)}"
            rows.append((n, " ".join(copy) if r.random() < 0.8 else " \t".join(copy).upper()))
            n += 1
    hot = words(r, 200).split()
    for _ in range(60):  # one large group of near copies, many exact
        copy = list(hot)
        copy[r.randrange(200)] = f"y{r.randrange(20)}"
        rows.append((n, " ".join(copy)))
        n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "a b c a b c"), (n + 7, "a b c a b c a b c")]


@pytest.mark.parametrize("k, num, block", [(3, 90, 1024), (5, 80, 1024), (3, 90, 8)])
def test_join_equals_brute_force(spark, monkeypatch, k, num, block):
    """A block of 8 documents exercises the way hot n-grams are dealt out."""
    from sedge.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_documents(frame(spark, rows), Rule(k, num, 100, buckets=1 << 16)).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_join_of_odd_rows(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (2, "A B C D"), (9, "z")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in join_documents(frame(spark, rows), Rule(buckets=1 << 16)).collect())
    assert got == [(-1, None), (2, 2), (3, 2), (3, 2), (9, 9)]
    kept = keep_one(frame(spark, rows), Rule(buckets=1 << 16))
    assert kept.columns == frame(spark, rows).columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 9]
    assert join_documents(frame(spark, rows).where("false"), Rule(buckets=1 << 16)).count() == 0


@pytest.mark.parametrize("turn", [1, -1])
def test_join_of_ids_with_several_texts(spark, turn):
    """An id that repeats with two texts is one document with the links of both, in whatever order rows come."""
    a, b = "one two three four five six seven eight nine ten", "k l m n o p q r s t u v"
    rows = [(1, a), (1, b), (2, a), (3, b.upper()), (5, "x y z"), (5, None), (4, "x  y z"), (6, None)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join_documents(frame(spark, rows[::turn]), Rule(buckets=1 << 16)).collect())
    assert got == [(1, 8, 1), (1, 10, 1), (2, 8, 1), (3, 10, 1), (4, 1, 4), (5, 0, 4), (5, 1, 4), (6, 0, 6)]


def test_join_needs_no_pairs_of_a_large_group(spark, monkeypatch):
    """Near copies that link with few of their group: at most an edge a row leaves a task, and all links are found."""
    from sedge.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r, rows = random.Random(5), []
    base = words(r, 60, 10_000).split()
    for n in range(150):
        copy = list(base)
        for at in r.sample(range(60), r.choice([1, 2, 2, 3])):
            copy[at] = f"z{r.randrange(12)}"
        rows.append((n, " ".join(copy)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in join_documents(frame(spark, rows), Rule(buckets=1 << 16)).collect()}
    want = brute_components(rows, 3, 90, 100)
    assert got == want and 1 < len({c for _, c in want.values()}) < 140


# ---- decontamination ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [50_000, 9])
def test_items_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    r = random.Random(2)
    items = [(n, words(r, r.choice([1, 3, 5, 6, 12, 40, 70]), 3000)) for n in range(25)] + [(90, None), (91, ""), (None, "q r s")]
    docs = []
    for n in range(60):
        parts = words(r, r.randint(0, 300), 3000).split()
        if n % 3 == 0:
            item = r.choice(items[:25])[1].split()
            for _ in range(n % 4):
                item[r.randrange(len(item))] = "changed"
            at = r.randint(0, len(parts))
            parts = parts[:at] + item + parts[at:]
        docs.append((n, " ".join(parts)))
    docs += [(100, None), (101, ""), (None, items[5][1]), (102, items[6][1].upper() + "\n" + words(r, 30_000, 50_000))]
    want = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            v = (x or "").lower().split()
            k = min(5, len(v))
            if not v or i is None:
                continue
            own = {tuple(v[n : n + k]) for n in range(len(v) - k + 1)}
            here = {tuple(w[n : n + k]) for n in range(len(w) - k + 1)}
            if 100 * len(own & here) >= 80 * len(own):
                want.add((d, i, len(own & here), len(own)))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert set(map(tuple, find_items(frame(spark, docs), table).collect())) == want and len(want) > 15
    listed = with_matches(frame(spark, docs), table, "found").select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
    assert set(map(tuple, listed.collect())) == want
    clean = drop_contaminated(frame(spark, docs), table)
    assert clean.columns == frame(spark, docs).columns
    assert Counter(x["doc_id"] for x in clean.collect()) == Counter(d for d, _ in docs if d not in {x[0] for x in want})
    assert find_items(frame(spark, docs), table.where("false")).count() == 0 == find_items(frame(spark, docs).where("false"), table).count()


# ---- line dedup -----------------------------------------------------------------------------------------------------


def brute_whole(rows, least):
    """From all runs of `least` words or more that start and end with words."""
    order, first, gone = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), {}, {}
    for n, (_, t) in enumerate(order):
        lines = (t or "").split("\n")
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for i, j in itertools.combinations_with_replacement(range(len(lines)), 2):
            if sizes[i] and sizes[j] and sum(sizes[i : j + 1]) >= least and first.setdefault("\n".join(lines[i : j + 1]), (n, i)) != (n, i):
                gone.setdefault(n, set()).update(range(i, j + 1))
    return {d: (len((t or "").split("\n")), len(gone.get(n, ())), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(n, ()))) for n, (d, t) in enumerate(order)}


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    pool = [words(r, r.randint(0, 12), 60) for _ in range(14)] + [words(r, 60), ""]
    rows = [(n, "\n".join(r.choice(pool) if r.random() < 0.7 else words(r, 6, 5000) for _ in range(r.randint(1, 30)))) for n in range(40)]
    rows += [(100, None), (101, ""), (102, pool[-2]), (103, pool[-2] + "\n" + pool[-2]), (104, "\n\n\n")]
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in dedup_lines(frame(spark, rows), 20).collect()}
    assert got == brute_whole(rows, 20) and sum(x[1] > 0 for x in got.values()) >= 15


def test_lines_of_odd_rows(spark):
    long = " ".join(map(str, range(60)))
    got = dedup_lines(frame(spark, [(5, long), (5, long), (None, long + "\nx"), (7, "\n".join([long] + ["y"] * 3000))])).collect()
    assert sorted((x["doc_id"] or -1, x["n_dropped"]) for x in got) == [(-1, 0), (5, 1), (5, 1), (7, 3000)]
    assert dedup_lines(frame(spark, [(1, "x")]).where("false")).count() == 0
    plan = dedup_lines(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_repeats_go(spark):
    """The tail of a repeat goes with it, also where it is shorter than a window."""
    r = random.Random(5)
    pool = [words(r, r.randint(0, 12), 60) for _ in range(10)] + [words(r, 60), words(r, 25), "", " "]
    rows = []
    for n in range(50):
        own = [r.choice(pool) if r.random() < 0.6 else words(r, 6, 5000) for _ in range(r.randint(1, 25))]
        if rows and n % 3 == 0:  # a stretch of an earlier document
            other = r.choice(rows)[1].split("\n")
            at = r.randrange(len(other))
            own[r.randrange(len(own)) :] = other[at : at + r.randint(1, 15)]
        rows.append((n, "\n".join(own)))
    rows += [(200 + n, "\n".join(" ".join(f"{k}_{m}" for m in range(size)) for k, size in enumerate(sizes))) for n, sizes in enumerate([(10, 22, 93, 2)] * 2)]
    rows += [(300, None), (301, ""), (302, pool[10] + "\n\n" + pool[11]), (303, pool[10] + "\n\n" + pool[11]), (304, "\n\n")]
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in dedup_lines(frame(spark, rows), 20).collect()}
    assert got == brute_whole(rows, 20) and got[201][2] == "" and got[303][1] == 3
    plan = dedup_lines(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- tokens ---------------------------------------------------------------------------------------------------------


def odd_texts(n=1500):
    r = random.Random(3)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["<|endoftext|>", "a<|startoftext|>b", "<s> </s> <unk>", "it's 'T'"]


def test_encoder_and_counter_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t, p = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), tokenizer_path("piece_bpe_32k.model")
    sp, encoder, counter = sentencepiece.SentencePieceProcessor(model_file=p), TokenEncoder(tokenizer_path("word_bpe_49k.json")), PieceCounter(p)
    assert encoder.exact and counter.exact
    texts = odd_texts()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(sp.encode(text))


def test_encoder_with_a_small_cache_and_tokens_in_one_text():
    encoder = TokenEncoder(tokenizer_path("word_bpe_49k.json"), cache=50)
    texts = odd_texts(400)
    for at in range(0, len(texts), 7):
        for text, ids in zip(texts[at : at + 7], encoder.encode(texts[at : at + 7]), strict=True):
            assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    tokens = [f"w{n}x".translate(str.maketrans("0123456789", "abcdefghij")) for n in range(450)] + ["'s", "7", "--", "été"]
    assert encoder._joined(tokens) == encoder._each(tokens)
    assert encoder._joined(["a", "b c", "d"]) == encoder._each(["a", "b c", "d"])  # cut into four: taken one by one
    assert encoder._joined([" ", "x"]) == encoder._each([" ", "x"]) and encoder._joined([]) == encoder._each([])


def test_token_counts_of_whole_tables(spark):
    import sentencepiece

    p = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=p)
    rows = [*enumerate(odd_texts(60)), (900, None), (901, ""), (901, ""), (None, "x"), (902, "long words " * 30_000)]
    got = Counter(map(tuple, count_tokens(frame(spark, rows), p).collect()))
    assert got == Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows)
    assert count_tokens(frame(spark, rows).where("false"), p).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [*enumerate(odd_texts(40)), (500, None), (501, ""), (502, "b" * 5), (502, "a b"), (None, "n u l l"), (503, "long text, " * 20_000)]
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark, rows), path, tokenizer_path("word_bpe_49k.json"), partitions=3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, text in order:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, digests(read_tokens(spark, path)).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, read_index(spark, path).select("doc_id", "start", "n_tokens").collect()), key=lambda r: r[1]) == [w[:3] for w in want]
    only = read_tokens(spark, path).where("doc_id = 503").select("n_tokens")
    assert "GreaterThan" not in only._jdf.queryExecution().toString() and "EqualTo(doc_id,503)" in only._jdf.queryExecution().toString()
    for f in tmp_path.glob("tokens/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            by = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(v for k, v in by.items() if k.startswith("ids"))
            assert ids.has_offset_index and any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in by["doc_id"].encodings
    write_tokens(frame(spark, rows).where("false"), str(tmp_path / "none"), tokenizer_path("word_bpe_49k.json"))
    assert digests(read_tokens(spark, str(tmp_path / "none"))).count() == 0


# ---- mixing ---------------------------------------------------------------------------------------------------------


def test_targets_by_hand():
    sizes = {"a": 100, "b": 1000, None: 1000, "z": 0}
    weights = mixing.cycle_weights(list(sizes))
    assert weights == {"a": 3, "b": 1, "z": 2, None: 3}
    got = mixing.targets(sizes, weights)
    assert got["a"] == 200 and got["z"] == 0 and abs(sum(got.values()) - 3150) < 1e-9 and got[None] == 2000 and got["b"] == 950


def test_mix(spark):
    r = random.Random(7)
    rows = [(n, words(r, r.randint(0, 60)), r.choice(["src0"] * 4 + ["b", "é", None])) for n in range(3000)] + [(5000, None, "src0"), (None, "a b", "b"), (5001, "", "only empty"), (5002, "x y", "b"), (5002, "x y", "b")]
    out = mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    for x in out:
        assert x["mix_copies"] <= 2 and x["mix_size"] == len((x["text"] or "").split())
        taken[x["source"]] += x["mix_copies"] * x["mix_size"]
        target[x["source"]] = x["mix_target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.06 * t
    again = {(x["doc_id"], x["text"]): x["mix_copies"] for x in mix(frame(spark, rows).repartition(7)).collect()}
    assert again == {(x["doc_id"], x["text"]): x["mix_copies"] for x in out}
    assert emitted(mix(frame(spark, rows)), frame(spark, rows).columns).count() == sum(x["mix_copies"] for x in out)
    assert mix(frame(spark, rows).where("false")).count() == 0


def test_mix_of_more_sources_than_are_broadcast(spark, monkeypatch):
    r = random.Random(8)
    names = [f"s{n}" for n in range(60)] + ["é", "\U0001f389", "\uffee", None, "none"]
    rows = [(n, None if s == "none" else words(r, r.choice([1, 5, 200])), s) for n, s in enumerate(names * 3 + ["s7"] * 400)]

    def result():
        return {x["doc_id"]: (x["mix_size"], x["mix_source_size"], round(x["mix_target"], 6), x["mix_copies"]) for x in mix(frame(spark, rows)).collect()}

    want = result()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    monkeypatch.setattr(mixing, "HOT", 0.1)
    assert result() == want and len(want) == len(rows)
    assert mix(frame(spark, rows)).columns == mix(frame(spark, rows).where("source = 's1'")).columns


# ---- personal data --------------------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text):
    return sorted(((m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if pii.valid(pii.KINDS[k], m.group())), key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    r = random.Random(8)
    for _ in range(20_000):
        text = "".join(r.choice("a1 2-.@+()%x9\n0é5.@1") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("1" * 200_000 + "." + "@" * 1000) == []


def test_the_field_adds_what_patterns_miss_and_leaves_prose_alone(spark):
    field = pii.default_field()
    held = pii.examples(300, seed=99)
    found = pii.find([t for t, _ in held], field)
    gold = {(n, a, b, k) for n, (_, spans) in enumerate(held) for a, b, k in spans}
    got = {(n, a, b, pii.KINDS[k]) for n, (_, every) in enumerate(found) for a, b, k in every}
    base = {(n, a, b, pii.KINDS[k]) for n, (spans, _) in enumerate(found) for a, b, k in spans}
    assert base <= got and len(got & gold) > 0.97 * len(gold) and len(got & gold) > len(base & gold) and len(got - base - gold) < 0.02 * len(gold)
    text = "Call (499) 555-6503 or +1 (332) 555-0400 4111111111111111, éé a.b@c.example.com"
    (b, e) = pii.find([text], field)[0]
    assert pii.as_text(b) == "email:60:79".replace("60", str(text.index("a.b"))).replace("79", str(len(text)))
    assert {text[x:y] for x, y, _ in e} == {"(499) 555-6503", "+1 (332) 555-0400", "4111111111111111", "a.b@c.example.com"}
    rows = [(1, text), (1, text), (2, None), (None, "version 3.0, 2020-10-11 at 12:30"), (3, "plain words " * 5000)]
    out = {x["doc_id"]: x for x in pii.find_pii(frame(spark, rows)).collect()}
    assert out[1]["n_email"] == 1 and out[1]["n_added"] == 3 and out[2]["spans"] == out[None]["spans"] == out[3]["spans"] == ""
    assert pii.find_pii(frame(spark, rows).where("false")).count() == 0


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(1)
    field = pii.Field({}, np.zeros((3, 0, pii.LABELS)), r.standard_normal((pii.LABELS, pii.LABELS)) + pii._allowed())
    runs = [r.standard_normal((n, pii.LABELS)) for n in (1, 2, 3, 4, 3)]
    for e, path in zip(runs, field.decode(runs), strict=True):

        def value(p, e=e):
            return field.moves[0, p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p)) + field.moves[p[-1], 0]

        assert tuple(path) == max(itertools.product(range(pii.LABELS), repeat=len(e)), key=value)


def test_scratch_tables_survive_and_go(spark):
    s = Scratch(spark)
    df = s.save(spark.range(5), "t")
    assert df.count() == 5
    path = s.paths[id(df)]
    s.drop(df)
    import os

    assert not os.path.exists(path.removeprefix("file:"))
