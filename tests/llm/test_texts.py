"""Fingerprints, tokens, pages, mixing and the pipeline."""

import base64
import hashlib
import html
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import bpe, exact_dedup, fingerprints, fit, html_text, line_dedup, mixing, queries, toxicity
from conftest import SMALL
from llm.data import ROWS, SCHEMA, docs, empty, labels
from llm.test_dedup import brute_near
from test_queries import TABLES, plain

# ---------------------------------------------------------------- SQL twins


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), db.sql(queries.SQL[name]).df()
    assert len(ours) and sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


# ---------------------------------------------------------------- fingerprints


def cells(text):
    out, cell = Counter(), ()
    for word in text.replace("\n", " \n ").split(" "):
        for part in [word] if len(word) <= fingerprints.LONGEST else [word[i : i + fingerprints.PIECE] for i in range(0, len(word), fingerprints.PIECE)]:
            cell += (part,)
            if part == "\n" or xxhash.xxh3_64_intdigest(part.encode()) % fingerprints.EVERY == 0:
                out[cell] += 1
                cell = ()
    return out + Counter([cell] if cell else [])


def brute_likeness(a, b):
    a, b = cells(a), cells(b)
    return sum((a & b).values()) / sum((a | b).values())


def check_fingerprints(rows, got):
    """rows in order; got by position."""
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        changed = text[: len(text) - k] + following[:k]
        r = got[i]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(brute_likeness(text, changed)) and r["near_next"] == pytest.approx(brute_likeness(text, following))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (cells(text) == cells(changed))


def test_fingerprint_query(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted(fingerprints.op3_fingerprints(spark, SMALL).collect(), key=lambda r: r["doc_id"])
    check_fingerprints(rows, got)
    by_text = {}
    for (_, text), r in zip(rows, got, strict=True):
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_messy_fingerprints(spark):
    rows = sorted([(r[0], r[1] or "") for r in ROWS if r[0] not in (None, 2)])
    distinct = docs(spark).where("doc_id is not null and doc_id <> 2")
    check_fingerprints(rows, sorted(fingerprints.fingerprint(distinct).collect(), key=lambda r: r["doc_id"]))
    assert fingerprints.fingerprint(docs(spark)).count() == len(ROWS)
    assert fingerprints.fingerprint(empty(spark)).count() == 0
    alone = fingerprints.fingerprint(docs(spark).where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_difference_of_two_fingerprints():
    texts = ["a\nb\nc\nd", "a\nb\nx\nd", "\n".join(map(str, range(100)))]
    cell_keys, paragraphs = fingerprints.keys_of(texts)
    a, b, c = fingerprints.fingerprints_of(cell_keys, paragraphs)
    only_a, only_b = fingerprints.differing(a, base64.b64encode(b).decode())
    key, at = paragraphs
    assert set(only_a) == set(key[at[0] : at[1]].tolist()) - set(key[at[1] : at[2]].tolist()) and len(only_b) == 1
    assert fingerprints.differing(a, a) == ([], []) and fingerprints.likeness_of(a, a) == 1.0
    assert fingerprints.likeness_of(a, b) == pytest.approx(brute_likeness(texts[0], texts[1]))


def test_stored_fingerprints_tell_real_edits(spark):
    """Between each text and its edited one, the paragraphs that differ and the likeness come out of the fingerprints alone."""
    rows = [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    told = like = 0
    for i, text in enumerate(rows):
        changed = fingerprints.edited(text, rows[(i + 1) % len(rows)])
        cell_keys, (key, at) = fingerprints.keys_of([text, changed])
        a, b = fingerprints.fingerprints_of(cell_keys, (key, at))
        own, new = set(key[: at[1]].tolist()), set(key[at[1] :].tolist())
        if (found := fingerprints.differing(a, b)) is not None:
            told += 1
            assert set(found[0]) == own - new and set(found[1]) == new - own
        if (share := fingerprints.likeness_of(a, b)) is not None:
            like += 1
            assert share == pytest.approx(brute_likeness(text, changed))
    assert told > 0.97 * len(rows) and like > 0.9 * len(rows)


def test_an_inserted_word_changes_its_cell_only():
    words = [f"word{i}" for i in range(200)]
    assert brute_likeness(" ".join(words), " ".join([*words[:5], "new", *words[5:]])) > 0.9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab \n", max_size=80), min_size=2, max_size=6))
def test_likeness(texts):
    keys, _ = fingerprints.keys_of(texts)
    n = len(texts)
    a, b = np.arange(n), (np.arange(n) + 1) % n
    assert fingerprints.likeness(keys, keys, a, b).tolist() == pytest.approx([brute_likeness(texts[i], texts[(i + 1) % n]) for i in range(n)])


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))


def test_token_query(spark, tokenizer):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in bpe.op8_byte_bpe(spark, SMALL).collect():
        ids = np.array(tokenizer.encode_ordinary(rows[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest())


def test_messy_tokens(spark, tokenizer):
    out = bpe.encode(docs(spark), public_tokenizers.path(bpe.VOCABULARY)).collect()
    want = Counter((r[0], tuple(tokenizer.encode_ordinary(r[1] or "")), r[1] or "") for r in ROWS)
    assert Counter((r["id"], tuple(r["ids"]), r["decoded"]) for r in out) == want
    assert bpe.encode(empty(spark), public_tokenizers.path(bpe.VOCABULARY)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab !\n'st", max_size=120), st.lists(st.sampled_from(["th", "e", "ing", "tion", "re", "é", "ß", "un"]), max_size=40).map("".join)), max_size=8))
def test_replay_equals_one_merge_at_a_time(merges, tokenizer, texts):
    got = list(merges.encode(texts, regex.compile(public_tokenizers.PATTERN)))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode_ordinary(t) for t in texts]
    assert [merges.decode(g).decode() for g in got] == texts


def test_long_runs(merges, tokenizer):
    texts = ["a" * 3000, "!" * 2999, "ab" * 1500, "ting" * 700 + "ing" * 500, "\n" * 500 + " " * 501]
    assert [np.frombuffer(g, "<u4").tolist() for g in merges.encode(texts, regex.compile(public_tokenizers.PATTERN))] == [tokenizer.encode_ordinary(t) for t in texts]


def test_merges_out_of_rank_order():
    """A vocabulary in which a merge opens a pair of lower rank: it must be taken at once."""
    tokens = [bytes([b]) for b in range(256)] + [b"xab", b"ab", b"ba"]
    m = bpe.Merges(tokens)
    assert not m.quiet[257]  # xab comes before ab

    def slow(word):
        ranks = {t: i for i, t in enumerate(tokens)}
        parts = [bytes([b]) for b in word]
        while pairs := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(3)
    words = [bytes(rng.choice(b"xab") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.replay(words)] == [slow(w) for w in words]


def test_kept_words_are_bounded(merges, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    split = regex.compile(public_tokenizers.PATTERN)
    first = list(merges.encode(["one two three four five six seven eight nine ten eleven"], split))
    assert list(merges.encode(["one two three four five six seven eight nine ten eleven"], split)) == first


# ---------------------------------------------------------------- pages


def brute_page(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))
    lines = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_page_query(spark):
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = html_text.op10_html_text(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_page(rows[r["page_id"]]["html"])
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), rows[r["page_id"]]["url"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<article><h1>T</h1><p>a <b>b</b>c\n d<p>e&nbsp;f<br>g</article><footer>no</footer>", "T\na bc d\ne f g"),
        ("<nav>no</nav><main><p>yes</p><div class='ad-box'>no</div><form><p>no</p></form></main>", "yes"),
        ("<article><p>yes</p><section id=comments><p>no</p></section><aside>no</aside></article>", "yes"),
        ("<article><p>1 < 2 &lt; 3</p><!-- <p>no</p> --><script>'</p>no'</script><style>p{}</style><ul><li>x<li>y</ul></article>", "1 < 2 < 3\nx\ny"),
        ("<body><div role=navigation>no</div><div hidden>no</div><p>yes &#x41;&#66;&euro;&unknown;</p><textarea>no</textarea>", "yes AB€&unknown;"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p>cut off <b>in the mid", "cut off in the mid"),
        ("<p>a</p><p title='x > y'>b</p></div></article>c", "a\nb\nc"),
        ("<article><div class='header-image notices'>no</div><div class=addition>yes</div></article>", "yes"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
        ("<header><article>no</article></header><article>yes</article>", "yes"),
        ("<article><p>a</p><section id='related-work'><p>b</p></section><h2 id='search-algorithms'>c</h2><p class='no-comments'>d</p></article>", "a\nb\nc\nd"),
        ("<div class='page has-sidebar no-ads'><p>all of the text</p></div>", "all of the text"),
        ("<article><div class='post-header'><h1>title</h1></div><p>text <math>x = 1</math> and <label>a label</label></p></article>", "title\ntext x = 1 and a label"),
        ("<body><div><p>A long text that is what the page is about, with many words in it.</p><p>It goes on.</p></div><article><p>teaser</p></article></body>", "A long text that is what the page is about, with many words in it.\nIt goes on.\nteaser"),
        ("<div class=sidebar><p>everything that this page says stands in here</p></div><p>end</p>", "everything that this page says stands in here\nend"),
        ("<article><p>a text that is long enough to be most of this page</p><div class='comment-list'><p>no</p></div><div class=site-header>no</div><div class='related-posts'>no</div><div role=search>no</div></article>", "a text that is long enough to be most of this page"),
        ("<" * 50 + "a" + "<b" * 40, None),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_pages(page, text):
    got = html_text.main_text(page)
    assert isinstance(got, str) and (text is None or got == text)


def site(n=40):
    """Pages without an article element: only what recurs tells the template."""
    rows = []
    for i in range(n):
        same = "<div><span>Site of things</span><a href='/'>home</a></div>"
        share = "<p>This paragraph is on every page.</p>"
        rows.append((i, "http://Www.Example.org:80/x", f"<body>{same}<article><p>page {i} is about {i * 3}</p>{share}<div><a href='/a'>A</a><a href='/b'>B</a></div></article>{same}</body>"))
        rows.append((1000 + i, "https://u@other.net/y", f"<body>{same if i < 2 else ''}<div><p>other page {i}</p></div></body>"))
    return [*rows, (None, None, None), (5, None, "<p>x</p>")]


def test_templates(spark):
    pages = spark.createDataFrame(site(), "page_id long, url string, html string").withColumn("host", F.lit("own")).withColumn("marks", F.lit("own"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect() if r["page_id"] not in (None, 5)}
    assert got[3] == "page 3 is about 9\nThis paragraph is on every page."  # prose of an article stays, its link list goes
    assert got[1001] == "Site of thingshome\nother page 1" and got[1007] == "other page 7"  # two pages don't make a template
    hosts = {r["host"]: len(r["marks"]) for r in html_text.templates(pages).collect()}
    assert set(hosts) == {"example.org"}


def plain_site(n=40):
    """Neither article elements nor telling classes; paragraphs in the chrome; two groups of copies."""
    rng = random.Random(2)
    words = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(k))
    top = "<div class=x1><div><a href='/'>home</a> <a href='/a'>about</a></div><p>The place for things.</p></div>"
    end = "<div class=x9><p>All rights are kept by the owner of this site.</p><ul><li><a href='/t'>terms</a></li></ul></div>"
    texts = [words(60) for _ in range(n)]
    texts += [texts[0]] * 20 + [f"{texts[1]} edit{i}" for i in range(20)]
    body = [f"<h1>{t.split()[0]}</h1><div><p>{t}</p><p>{t[:50]}</p></div>" for t in texts]
    want = ["\n".join((t.split()[0], t, " ".join(t[:50].split()))) for t in texts]
    return [(i, "http://plain.org/p", f"<html><body>{top}<div class=c>{b}</div>{end}</body></html>") for i, b in enumerate(body)], want


def test_only_what_recurs_tells_a_plain_template(spark):
    rows, want = plain_site()
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(want))] == want
    without = html_text.main_text(rows[0][2])
    assert without == "home about\nThe place for things.\n" + want[0] + "\nAll rights are kept by the owner of this site.\nterms"


def test_templates_by_a_join(spark, monkeypatch):
    pages = spark.createDataFrame(site(), "page_id long, url string, html string")
    want = sorted(html_text.extract(pages).collect(), key=str)
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", -1)
    assert sorted(html_text.extract(pages).collect(), key=str) == want


@pytest.mark.parametrize(
    ("copied", "text"),
    [
        ("<article><div><p>Copied prose.</p></div></article>", "Copied prose."),
        ("<article><h1>T</h1><section><div><p>One.</p><div><a href='/a'>A</a><a href='/b'>B</a></div><p>Two.</p></div></section></article>", "T\nOne.\nTwo."),
        ("<article><ul><li>first point</li><li><a href='/x'>link</a></li></ul><table><tr><td>cell</td></tr></table><figure><img src=x><figcaption>Caption</figcaption></figure></article>", "first point\ncell\nCaption"),
        ("<main><div>Text without a paragraph, <b>bold</b>.</div><div><a href='/'>home</a></div></main>", "Text without a paragraph, bold."),
        ("<div><div><p>Prose of a page <a href='/'>without</a> article.</p></div></div><div><a href='/'>home</a></div><p><a href='/'>only</a> | <a href='/a'>links</a></p>", "Prose of a page without article."),
    ],
)
@pytest.mark.parametrize(("n", "of"), [(5, 50), (20, 60)])
def test_copied_pages_keep_their_prose(spark, copied, text, n, of):
    """A group of equal pages on a host, large enough for their subtrees to recur."""
    rows = [(i, "http://example.org/", copied if i < n else f"<article><p>page {i}</p></article>") for i in range(of)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(n)] == [text] * n and got[n] == f"page {n}"


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- mixing


def test_mixing_keeps_columns_and_weights(spark):
    rows = [(i, "x" * 100, "en", "big" if i % 10 else "small", 100) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()
    n = {r["source"]: r["n"] for r in out}
    for source in ("big", "small"):
        assert abs(n[source] - 2500) < 5 * math.sqrt(2500 * 5)
    messy = mixing.mix(docs(spark), output_share=3.0)
    assert set(docs(spark).columns) <= set(messy.columns) and len(messy.columns) == len(docs(spark).columns) + 3
    assert {r["mix_rate"] for r in messy.collect()} == {"own mix_rate"}
    assert mixing.mix(empty(spark)).count() == 0


def test_draws_are_poisson(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    n = Counter(r["c"] for r in mixing.mix(df, output_share=1.5).groupBy("doc_id").agg(F.count("*").alias("c")).collect())
    for k in range(1, 6):
        p = math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(n[k] - 20_000 * p) < 5 * math.sqrt(20_000 * p)
    with pytest.raises(ValueError, match="repeated"):
        mixing.mix(df, output_share=1e4).count()


def test_a_tiny_source_beside_a_large_one(spark):
    """The rate of the tiny source is thousands; each document of it has about as many copies, by the quantile of its uniform number."""
    rows = [(i, "x" * 1000, "en", "large", 1000) for i in range(40_000)] + [(100_000 + i, "y", "en", None, 1) for i in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("source is null").groupBy("doc_id").agg(F.count("*").alias("c"), F.max("mix_rate").alias("rate"), F.max("mix_copy").alias("last")).collect()
    rate = math.sqrt(20) / (math.sqrt(20) + math.sqrt(40_000_000)) * 40_000_020 / 20
    assert rate > mixing.DIRECT_RATE and len(out) == 20
    for r in out:
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:12], 16) / (1 << 48)
        below = lambda k: math.fsum(math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) for j in range(k))
        assert abs(r["rate"] / rate - 1) < 1e-9 and r["c"] == r["last"] and below(r["c"]) <= u + 1e-9 and u - 1e-9 < below(r["c"] + 1)


def test_mixing_sql_with_repeated_rows_and_large_rates(spark, tmp_path):
    rows = [(i, "x" * 3000, "en", "a", 1) for i in range(200)] + [(7, "x" * 3000, "en", "a", 1)] * 2 + [(1000, "tiny", "en", "b", 4)] * 2 + [(1001, None, "en", None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours, theirs = mixing.op9_mix_sources(spark, str(tmp_path)).toPandas(), db.sql(mixing.SQL).df()
    assert ours[ours.source == "b"].rate.max() > 200 and plain(ours) == plain(theirs)


@pytest.mark.parametrize("rate", [500.5, 700.0, 12_345.6, 1e6, 1e9])
def test_distribution_of_a_large_rate(rate):
    low, cdf = mixing.distribution(rate)
    p = np.diff(cdf)
    k = np.arange(low + 1, low + len(cdf))
    mean = float((p * k).sum()) + cdf[0] * low
    assert abs(mean / rate - 1) < 1e-7 and abs(float((p * (k - mean) ** 2).sum()) / rate - 1) < 1e-4 and cdf[0] < 1e-20 and cdf[-1] == 1.0
    if rate < 1000:  # the direct recurrence still works, from the smallest doubles on
        term, total, want = math.exp(-rate), math.exp(-rate), []
        for j in range(1, low + len(cdf)):
            term *= rate / j
            total += term
            want.append(total)
        assert np.allclose(want[low:], cdf[1:], atol=1e-9)


def test_a_rate_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "en", None, 0), (2, "", "en", None, 0), (3, "abc", "en", "s", 3)], SCHEMA)
    assert {r["mix_rate"] for r in mixing.mix(df, {"s": 0.0, None: 1.0}).collect()} <= {1.0}


# ---------------------------------------------------------------- pipeline


def brute_copies(rows, seed=mixing.SEED):
    """How often each row is in the mixture: for each source the Poisson quantile of a hash of the id."""
    chars = Counter()
    for r in rows:
        chars[r["source"]] += len(r["text"] or "")
    total, weight = sum(chars.values()), sum(c**mixing.POWER for c in chars.values())
    out = Counter()
    for r in rows:
        c = chars[r["source"]]
        rate = c**mixing.POWER / weight * total / c
        u = int(hashlib.md5(f"{seed}:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        k, term = 0, math.exp(-rate)
        below = term
        while below <= u:
            k += 1
            term *= rate / k
            below += term
        out[r["doc_id"]] += k
    return +out


def test_pipeline_against_brute_force(spark, tokenizer):
    """Each stage on the last one's rows, held against its own definition."""
    docs_in = spark.read.parquet(f"{SMALL}/documents.parquet")
    (_, toxic), (_, exact), (_, near), (_, mixed), (_, tokens) = corpus_pipeline.STAGES
    model = toxicity.train(docs_in, spark.read.parquet(f"{SMALL}/labels.parquet"))
    found = toxicity.automaton(model["lexicon"], model["exceptions"])

    def score(text):
        weight, hits = toxicity.matched(toxicity.fold(text or ""), found)
        return fit.probability(model["calibration"], toxicity.features(np.array([weight]), np.array([hits]), np.array([len(text or "")])))[0]

    one = exact_dedup.materialise(toxic(spark, docs_in, SMALL))
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs_in.collect() if score(r["text"]) < 0.5}
    two = exact_dedup.materialise(exact(spark, one, SMALL))
    best = {}
    for r in one.collect():
        key = (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(best.values())
    three = exact_dedup.materialise(near(spark, two, SMALL))
    gone = brute_near([(r["doc_id"], r["text"]) for r in two.collect()])
    assert gone and sorted(r["doc_id"] for r in three.collect()) == sorted(set(best.values()) - gone)
    four = exact_dedup.materialise(mixed(spark, three, SMALL))
    for stage in (one, two, three, four):
        assert stage.columns == docs_in.columns
    assert Counter(r["doc_id"] for r in four.collect()) == brute_copies(three.collect())
    want = Counter((r["doc_id"], tuple(tokenizer.encode_ordinary(r["text"] or ""))) for r in four.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens(spark, four, SMALL).collect()) == want
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SMALL).collect()) == want


def test_messy_pipeline(spark, tmp_path):
    labels(spark, [(1, 1, 0), (6, 0, 1)]).write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs(spark), empty(spark)):
        df, before = rows, rows.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = exact_dedup.materialise(stage(spark, df, str(tmp_path)))
            assert df.columns == corpus_pipeline.COLUMNS, name
        out = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
        assert out.columns == ["doc_id", "n_tokens", "ids"] and (out.count() > 0) == (before > 0)


def test_stage_names_and_guard():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "source mixing", "byte-level BPE"]
    assert line_dedup.LEAST == 10


def test_stages_send_python_small_batches(spark):
    """Batches of whole texts stay at about a megabyte, whatever the texts' length."""
    wide = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words ', 200)").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(2200).alias("n_chars"))

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"]) for b in batches)

    for name, stage in corpus_pipeline.STAGES:
        if name in ("SimHash near-dedup", "byte-level BPE"):
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
            stage(spark, wide.limit(0), SMALL)
            most = wide.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]
            assert most < 2 << 20, name


def test_encoder_keeps_no_words_after_a_task(spark):
    run = bpe._encoded(spark, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, True)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a few words to keep"])], names=["id", "text"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 1
    kept = bpe._unshipped(bpe._shipped(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))).known
    assert not kept
