"""Quality, toxicity and language: held-out accuracy, edge cases and the parts they are made of."""

import zlib

import numpy as np
import pytest

from cellweave.llm import fit, language, quality, toxicity
from llm.data import ROWS, SCHEMA, docs, empty, labels

SF = "/root/testdata/sf0.01"


def held(ids, by, remainder):
    return np.array([zlib.crc32(str(i).encode()) % by == remainder for i in ids])


def with_labels(spark, out, label):
    return out.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").toPandas()


def test_quality_on_held_out_rows(spark):
    out = quality.op1_quality(spark, SF).toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert (out.held_out == held(out.doc_id, 3, 1)).all()
    known = with_labels(spark, quality.op1_quality(spark, SF), "quality")
    test = known[known.held_out]
    assert (test.predicted == test.quality).mean() > 0.94


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.01", "0.1")  # enough toxic rows are held out there
    known = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    assert (known.held_out == held(known.doc_id, 5, 0)).all()
    test = known[known.held_out]  # answering "clean" always would give 0.88
    toxic, clean = test[test.toxic == 1], test[test.toxic == 0]
    assert (test.predicted == test.toxic).mean() > 0.97 and (toxic.predicted == 1).mean() > 0.9 and (clean.predicted == 0).mean() > 0.98


def test_toxicity_learns_exceptions(spark):
    """An entry that toxic rows use alone and clean ones in one phrase only."""
    filler = "some quite ordinary words stand here for the length of it".split()
    text = lambda i, *more: " ".join([*(filler[(i + k) % len(filler)] for k in range(8)), f"w{i}", *more, filler[i % 5]])
    rows = [(i, text(i, "you", "trash") if i % 2 else text(i, "the", "trash", "can") if i % 8 == 2 else text(i), "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(df, labels(spark, [(i, 0, i % 2) for i in range(400)]))
    assert "trash can" in model["exceptions"] and "you trash" not in model["exceptions"]
    found = toxicity.automaton(model["lexicon"], model["exceptions"])
    assert toxicity.matched("put it in the trash can here", found)[0] < toxicity.matched("put it in you trash here", found)[0]
    without = toxicity.automaton(model["lexicon"])
    assert toxicity.matched("the trash can", without)[0] > toxicity.matched("the trash can", found)[0]


def test_language_on_held_out_rows(spark):
    out = language.op5_language(spark, SF)
    known = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    test = known[known.held_out & known.lang.notna()]
    assert (known.held_out == held(known.doc_id, 5, 0)).all() and (test.lang_pred == test.lang).mean() > 0.98


LABELS = [(i, int(i % 2), int(i % 3 == 0)) for i in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] + [(99, None, None), (None, 1, 1)]


@pytest.mark.parametrize("rows", [LABELS, [], [(1, 1, 1), (2, 1, 1)]])
def test_messy_rows(spark, rows):
    d, known = docs(spark), labels(spark, rows)
    for module in (quality, toxicity):
        out = module.score(d, module.train(d, known)).collect()
        assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["id"] in (3, 4)}) == 1  # null is as empty
        assert module.score(empty(spark), module.train(empty(spark), known)).count() == 0
        if not rows:
            assert {r["score"] for r in out} == {0.5}
    assert fit.scored(quality.score(d, quality.train(d, known)), 3, 1).where("doc_id is null and held_out").count() == 0


def test_messy_languages(spark):
    d = docs(spark)
    rows = language.predict(d, language.train(d, fold=(5, 9))).collect()  # no row is held out
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[3] == got[4] == got[5] == got[12] == ("und", 0.0) and got[6][0] == "en" and got[13][0] == "xx"
    nothing = language.train(empty(spark))
    assert {r["lang_pred"] for r in language.predict(d, nothing).collect()} == {"und"}
    assert language.predict(empty(spark), nothing).count() == 0


def test_ngram_counts_against_brute_force():
    import collections

    text = "Ab c! déJÀ"
    plain = " ab c déjà "
    grams = collections.Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))
    total = language.counts(text)
    assert total.sum() == sum(grams.values()) and (total > 0).sum() == len(grams)
    assert language.counts("12 !") is None and language.counts("") is None


@pytest.mark.parametrize("text", ["word " * 400 + "zz", "a  b!c", " é ", "ab" * 50 + "  !! "])
@pytest.mark.parametrize("stretch", [1, 2, 3, 64])
def test_stretches_change_nothing(text, stretch):
    assert (language.counts(text, stretch=stretch) == language.counts(text)).all()


def test_letters_of_late_planes_count():
    assert language.counts(chr(0x323AF)) is not None and language.counts("1" * 5) is None


def test_every_language_is_learned(spark):
    """More languages than keep all buckets: none is left out, and the model stays in its bounds."""
    known = [f"l{i}" for i in range(600)]
    rng = np.random.default_rng(5)
    own = [" ".join("".join(chr(0x4E00 + 30 * i + k) for k in rng.integers(0, 30, 6)) for _ in range(5)) for i in range(600)]
    df = spark.createDataFrame([(6 * i + k, own[i], known[i], "s", 1) for i in range(600) for k in range(6)], SCHEMA)
    model = language.train(df)
    assert model["languages"] == sorted(known) and model["weights"].size <= language.MODEL_CELLS + 600
    some = df.where("doc_id % 60 = 0").collect()
    got = {r["id"]: r["lang_pred"] for r in language.predict(df.where("doc_id % 60 = 0"), model).collect()}
    assert sum(got[r["doc_id"]] == r["lang"] for r in some) > 0.9 * len(some)


def test_language_fits_on_its_sample(spark, monkeypatch):
    """About sample_rows rows, even among the languages, however many there are."""
    fitted, fit_rows = [], language.follow_the_regularised_leader

    def seen(rows, *others):
        fitted.extend(y for *_, y in rows)
        return fit_rows(rows, *others)

    monkeypatch.setattr(language, "follow_the_regularised_leader", seen)
    rows = [(i, f"some words {i} of a text", "ab"[i % 20 == 0], "s", 1) for i in range(4000)]
    model = language.train(spark.createDataFrame(rows, SCHEMA), sample_rows=160)
    assert model["languages"] == ["a", "b"]
    assert 40 < fitted.count(0) < 100 and 40 < fitted.count(1) < 100  # 80 of each, a fifth of them held back


def test_no_language_goes_without_a_row(spark):
    """Also if all its rows are drawn late."""
    late = spark.range(2000).where("pmod(xxhash64('lang', id), 1 << 30) > 1 << 29").where("crc32(cast(cast(id as string) as binary)) % 5 <> 0 and pmod(xxhash64('part', id), 5) <> 0").limit(300).collect()
    rows = [(r["id"], "zwölf Boxkämpfer", "late", "s", 1) for r in late] + [(i, "some plain words", "other", "s", 1) for i in range(3000, 3300)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.train(df, sample_rows=16)
    assert language.predict(df.where("lang = 'late'").limit(1), model).first()["lang_pred"] == "late"


def test_regularisation_makes_weights_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for y in (0, 1):
        for _ in range(50):
            at = np.unique(np.concatenate(([100 + y], rng.integers(1000, 3000, 20))))
            rows.append((at, np.full(len(at), len(at) ** -0.5), y))
    w = language.follow_the_regularised_leader(rows, 2)
    assert (w == 0).mean() > 0.9 and w[100, 0] > w[100, 1] and w[101, 1] > w[101, 0]


def test_temperature():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    sure = np.column_stack([1 - y, y]) * 12.0
    flipped = np.where((rng.random(500) < 0.2)[:, None], sure[:, ::-1], sure)
    assert language.temperature(flipped, y) > 5 and language.temperature(sure, y) < 1


@pytest.mark.parametrize("text", ["IDIOT", "id­iot", "1d10t", "іdіоt", "ｉｄｉｏｔ", "i​diot"])
def test_disguises(text):
    assert toxicity.fold(text) == "idiot"


def test_folding_keeps_what_is_no_disguise():
    assert toxicity.fold("Straße 2024, déjà $$$ 100") == "straße 2024, déjà $$$ 100"


def test_matching():
    found = toxicity.automaton({"idiot": 2.0, "idio": 1.0, "trash": 3.0}, ("trash can",))
    assert toxicity.matched("an idiotic idiot, no lidiot", found) == (4.0, 2)
    assert toxicity.matched("trash in the trash can", found) == (3.0, 1)
    assert toxicity.matched("trash canvas", found) == (3.0, 1)
    assert toxicity.matched("", found) == (0, 0) and toxicity.matched("idiot", None) == (0, 0)


def test_lexicon():
    counts = [("idi", 90, 1), ("idio", 90, 1), ("idiot", 90, 0), ("the", 100, 1000), ("rare", 4, 0)]
    lexicon = toxicity.weights(counts, 100, 1000)
    assert "idi" in lexicon and "idio" not in lexicon and "the" not in lexicon


def test_length_normalisation(spark):
    """The same insults in a text a hundred times as long count for less."""
    model = {"lexicon": {"idiot": 3.0}, "exceptions": (), "calibration": {"mean": np.zeros(3), "scale": np.ones(3), "beta": np.array([-3.0, 0.0, 1.0, 0.0])}}
    rows = [(1, "you idiot"), (2, "you idiot" + " and so on" * 100)]
    out = {r["id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out[1] > 0.5 > out[2]


def test_calibration_learns_and_weighs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 1))
    y = (x[:, 0] + rng.normal(scale=0.3, size=400) > 0).astype(int)
    model = fit.calibrate(x, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    assert ((fit.probability(model, x) > 0.5) == y).mean() > 0.85
    rare = fit.calibrate(x, y, {0: 100 * int((y == 0).sum()), 1: int((y == 1).sum())})
    assert fit.probability(rare, x).mean() < 0.2


def test_compression_tells_texts_apart():
    rng = np.random.default_rng(2)
    text = lambda words: b" ".join(words[i] for i in rng.integers(0, len(words), 150))
    a, b = ([bytes(f"{p}{i}x{i * 7}", "ascii") for i in range(300)] for p in "ab")
    good, bad = (quality._dictionary([text(w) for _ in range(200)]) for w in (a, b))
    cg, cb = quality._compressor(good), quality._compressor(bad)
    new_a, new_b = text(a), text(b)
    assert quality._size(cg, new_a) < quality._size(cb, new_a) and quality._size(cg, new_b) > quality._size(cb, new_b)
    assert quality._dictionary([b"x" * 40]) == b"x" * 40
