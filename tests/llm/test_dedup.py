"""Exact, line and near deduplication, and their components, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.llm import components, exact_dedup, line_dedup, near_dup, simhash
from conftest import SMALL
from llm.data import PROSE, ROWS, docs, empty


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def roots_of(nodes, links):
    nodes = list(nodes)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- exact


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_all", [True, False])
@pytest.mark.parametrize("prefix", [1, 128])
def test_exact(spark, digest_all, prefix):
    got = exact_dedup.exact_dedup(docs(spark), digest_all=digest_all, prefix=prefix).collect()
    want = brute_exact(ROWS)
    if digest_all:
        assert sorted((tuple(r) for r in got), key=str) == want
    else:
        assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((w[:4] for w in want), key=str)
        assert all(r["digest"] is None or r["digest"] in {w[4] for w in want} for r in got)
        assert all(r["digest"] is not None for r in got if r["group_size"] > 1)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 and exact_dedup.exact_dedup(empty(spark), digest_all=True).count() == 0


def test_exact_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1)
    got = exact_dedup.exact_dedup(docs(spark)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((w[:4] for w in brute_exact(ROWS)), key=str)


# ---------------------------------------------------------------- lines

_BLANKS = " \t\n\x0b\f\r"


def brute_lines(rows):
    first = {}
    for doc_id, text, *_ in rows:
        rank = line_dedup.NO_ID if doc_id is None else doc_id
        for line in (text or "").split("\n"):
            key = lower(line.strip(_BLANKS))
            if len(key) >= 10:
                first[key] = min(first.get(key, rank), rank)
    out = []
    for doc_id, text, *_ in rows:
        rank = line_dedup.NO_ID if doc_id is None else doc_id
        lines = (text or "").split("\n")
        gone = [len(k) >= 10 and first[k] != rank for k in (lower(x.strip(_BLANKS)) for x in lines)]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc_id, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_lines(spark):
    maps = {r["id"]: (r["n_dropped"], bytes(r["keep_bitmap"])) for r in line_dedup.keep_bitmaps(docs(spark)).collect()}
    for doc_id, text, *_ in ROWS:
        want = next(w for w in brute_lines(ROWS) if w[0] == doc_id)
        n, bitmap = maps.get(line_dedup.NO_ID if doc_id is None else doc_id, (0, None))
        assert (n, line_dedup.kept_text(text or "", bitmap)) == (want[2], want[4])
    assert all(len(b) < 2000 for _, b in maps.values())


def test_line_in_many_documents(spark):
    """A line that most documents hold, so that its run goes through several partitions."""
    rows = [(i, f"the very same line\nline of its own {i}\nthe very same line", "en", "a", 1) for i in range(4000)]
    gone = line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert gone.groupBy("pos").count().orderBy("pos").collect() == [(0, 3999), (2, 3999)]
    assert gone.where("id = 0").count() == 0


def test_lines_empty(spark):
    assert line_dedup.keep_bitmaps(empty(spark)).count() == 0


# ---------------------------------------------------------------- components


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long") if links else spark.createDataFrame([], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    want = roots_of({x for l in links for x in l}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_long_chain(spark):
    df = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.connected_components(df).collect()} == {1}


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = [w for w in "".join("\0" if c in _BLANKS else c for c in lower(text)).split("\0") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > len(shingles))


def brute_components(fps):
    """Of distinct fingerprints with at most two different bits."""
    a = np.array(sorted(set(fps)), "u8")
    links = [(int(a[i]), int(x)) for i in range(len(a)) for x in a[i + 1 :][np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2]]
    return roots_of(map(int, a), links)


def test_fingerprints():
    for _, text, *_ in ROWS[:6] + ROWS[7:]:
        assert simhash.fingerprint(text or "") & (1 << 64) - 1 == brute_fingerprint(text)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    roots, least = brute_components(fps.values()), {}
    for i, fp in fps.items():
        least[roots[fp]] = min(least.get(roots[fp], i), i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (f"{fp:016x}", least[roots[fp]]) for i, fp in fps.items()}


@pytest.mark.parametrize("run", [2, 32])
def test_links_of_crowded_fingerprints(spark, run):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    fps |= {0, 1, 3, 7, (1 << 63) | 7}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, run=run).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert roots_of(fps, links) == brute_components(fps)


def test_messy_components(spark):
    got = simhash.near_dup_components(docs(spark)).collect()
    assert len(got) == len(ROWS)
    by_id = {r["id"]: r["component_id"] for r in got}
    assert by_id[3] == by_id[4] == by_id[5] == 3 and by_id[10] == by_id[8] == 8 and by_id[1] == by_id[7] == 1 and by_id[None] is None
    assert simhash.near_dup_components(empty(spark)).count() == 0


# ---------------------------------------------------------------- near duplicates by shingles


def shingle_sets(rows):
    return {i: set(simhash.shingle_hashes(simhash.words(t or ""), 5)) for i, t in rows}


def brute_near(rows):
    sets = shingle_sets(rows)
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s or {None}:
            where[x].append(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {n for n, r in roots_of(sets, alike).items() if n != r}


def test_near_duplicates_are_all_found(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    rng = random.Random(1)
    for k in range(60):  # planted copies with a few words changed
        words = rows[k][1].split(" ")
        for _ in range(len(words) // 60):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100_000 + k, " ".join(words)))
    got = {r["node"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_near(rows)
    assert got == want and len(want) > 40


def test_large_group_of_copies(spark):
    rows = [(i, PROSE + f" end {i}") for i in range(300)] + [(1000 + i, f"text number {i} has words {i * 7} {i * 11} of its own {i * 13}") for i in range(50)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["node"] for r in got} == set(range(1, 300)) and {r["root"] for r in got} == {0}


def edited_group(rng, n, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randrange(*edits)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(ws))
    return rows


@pytest.mark.parametrize("edits", [(0, 3), (1, 4), (3, 9)])
@pytest.mark.parametrize("members", [2, 64])
def test_crowded_runs(spark, monkeypatch, edits, members):
    """A large group of texts, alike or not in their shingles, most of which every run of a shingle holds."""
    monkeypatch.setattr(near_dup.block_pairs, "__defaults__", (7, 11))  # several blocks and chunks
    rows = list(enumerate(edited_group(random.Random(8), 120, edits)))
    got = {r["node"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), members=members).collect()}
    assert got == brute_near(rows)


def test_shingles_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SAMPLE", 1)
    monkeypatch.setattr(near_dup, "SHARE", 5)
    monkeypatch.setattr(near_dup.block_pairs, "__defaults__", (7, 11))
    rng = random.Random(9)
    rows = list(enumerate(edited_group(rng, 60, (1, 5)) + [" ".join(t.split()[: rng.randrange(90, 121)]) for t in edited_group(rng, 40, (0, 3))] + ["", "one two", "one  TWO", "\t"]))
    got = {r["node"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), members=4).collect()}
    want = brute_near(rows)
    assert got == want and len(want) > 40


def test_dissimilar_texts_in_one_run(spark):
    """Many texts that share a passage which is rare by the sample, but no more."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(9)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(12)])) for i in range(150)]
    rows += [(200 + i, t + " one") for i, t in rows[:10]]
    got = {r["node"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), members=8).collect()}
    assert got == brute_near(rows) == {200 + i for i in range(10)}


def test_rows_are_dropped_by_id_and_text(spark):
    """An id's other texts stay, whatever becomes of one of them."""
    schema = "doc_id long, text string"
    exact = spark.createDataFrame([(5, "A"), (9, "A"), (5, "B"), (3, "B")], schema)
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(exact).collect())) == [(5, "B"), (9, "A")]
    other = "quite another text that shares nothing with the first one"
    near = spark.createDataFrame([(3, PROSE), (5, PROSE), (5, other), (5, other), (6, PROSE + " end")], schema)
    assert sorted(map(tuple, near_dup.drop_near_duplicates(near).collect())) == [(3, PROSE), (5, other), (5, other)]


def block_edits(texts, rng):
    """Copies whose edit is one piece: cut off, appended, a block replaced; all 0.8 alike or more."""
    rows = []
    for k, ws in enumerate(texts):
        n = len(ws)
        new = [f"y{rng.randrange(10**6)}" for _ in range(n)]
        at = n // 3
        copies = {"own": ws, "cut": ws[: n - n * 18 // 100], "appended": ws + new[: n * 22 // 100], "replaced": ws[:at] + new[: n * 8 // 100] + ws[at + n * 8 // 100 :]}
        rows += [(k * 10 + i, kind, " ".join(c)) for i, (kind, c) in enumerate(copies.items())]
    return rows


@pytest.mark.parametrize("members", [2, 64])
def test_block_edits_are_all_found(spark, members):
    """Each copy with its original only, as copies of one text would find each other by chains."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(15)]  # a passage that all share
    edits = block_edits([[f"w{rng.randrange(2000)}" for _ in range(rng.randrange(150, 600))] + common for _ in range(80)], rng)
    for kind in ("cut", "appended", "replaced"):
        rows = [(i, t) for i, k, t in edits if k in ("own", kind)]
        want = brute_near(rows)
        assert len(want) == 80
        assert {r["node"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), members=members).collect()} == want, kind


def test_messy_near_duplicates(spark):
    kept = near_dup.drop_near_duplicates(docs(spark)).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(None) == 2 and ids.count(2) == 2 and 10 not in ids and 9 not in ids and 8 in ids and 7 not in ids
    assert 3 in ids and 4 not in ids and kept[0]["near_dup_id"] == "own near_dup_id"
    assert near_dup.drop_near_duplicates(empty(spark)).count() == 0
