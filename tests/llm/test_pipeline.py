"""Each stage of the pipeline against brute force on its own input, and whole runs over odd tables."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkveil.llm import language, quality, secrets, store
from inkveil.llm.queries import VOCABULARY, held_out, table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(ws, k):
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]

    # Quality: every document is compared with every labelled vector.
    labels = table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text").where(~held_out()), labels.where(~held_out()))
    good = store.stash(stages[0](spark, docs, SF), "good")
    kept = {r.doc_id for r in good.collect()}
    for r in docs.collect():
        x = model.latent(np.concatenate(list(quality.features(pa.array([r.text])))))[0]
        cos = np.array([float(x @ v) for v in model.vectors])
        last = np.sort(cos)[-min(15, len(cos))]
        weight = np.where(cos >= last - 1e-7, np.maximum(cos, 0), 0) ** 4
        score = float((weight * model.labels).sum() / weight.sum()) if weight.sum() else model.labels.mean()
        assert (r.doc_id in kept) == (score >= 0.3) or abs(score - 0.3) < 1e-4

    # Near-duplicates: the least id of each component stays.
    single = store.stash(stages[1](spark, good, SF), "single")
    texts = {r.doc_id: r.text for r in good.collect()}
    sets, root = {d: shingles(words(t), 5) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.doc_id for r in single.collect()} == {d for d in texts if find(d) == d}

    # Decontamination: documents that hold four fifths of an item's shingles go.
    clean = store.stash(stages[2](spark, single, SF), "clean")
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = [cut(r.text) for r in table(spark, SF, "benchmark").collect()]
    parts = [(shingles(ws, min(5, len(ws))), min(5, len(ws))) for ws in items if ws]
    hit = {d for d in (r.doc_id for r in single.collect()) for s, k in parts if 100 * len(s & shingles(cut(texts[d]), k)) >= 80 * len(s)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit

    # Secrets: all documents stay, and a text changes only where the forest names a secret.
    safe = store.stash(stages[3](spark, clean, SF), "safe")
    assert safe.columns == docs.columns
    found = secrets.find_secrets(clean, secrets.train(secrets.labelled_findings(spark))).where("is_secret").collect()
    after = {r.doc_id: r for r in safe.collect()}
    assert set(after) == {r.doc_id for r in clean.collect()}
    for d, r in after.items():
        hidden = [f.value for f in found if f.doc_id == d]
        assert (r.text != texts[d]) == bool(hidden) and all(v not in r.text for v in hidden if len(v) >= 16)
        assert not hidden or r.n_chars == len(r.text)

    # Packing: the tokens of every document, in its pieces.
    library, held = Tokenizer.from_file(VOCABULARY), {}
    for r in stages[4](spark, safe, SF).collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == {d: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in after.items()}


@pytest.mark.parametrize("n", [0, 12])
def test_odd_tables(spark, tmp_path, n):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _id int, quality_score string, _values int"
    key = "0f343b0931126a20f133d67c2b018a3b0f343b09"
    rows = [(1, "a b c d e f g", "en", None, 13, 1, "x", 2)] * 3 + [(1, f"token = {key} end", "en", "s", 5, 1, "x", 2), (None, None, None, None, None, None, None, None), (None, "", None, None, 0, None, None, None), (2, "A b c d e f g", "de", "s", 13, 1, "x", 2), (3, "word " * 30_000, "en", "s", 150_000, 1, "x", 2), (4, "what is the capital of france", None, None, 29, 1, None, 1), (5, "x" * 200_000, "en", "s", 1, 1, None, 1), (6, " \n", "en", "s", 1, 1, None, 1), (7, f"my api_key={key}", "en", "s", 1, 1, "y", 1)]
    spark.createDataFrame(rows[:n], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 1), (None, 0, 0)][: n or 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "What is the capital of France?"), (2, None), (None, "a b c d e f g")][: n or 0], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    there = set(store._THERE)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert len(set(store._THERE) - there) == 1  # what the stages wrote on the way is gone
    if not n:
        assert not got
        return
    ids = [r.doc_id for r in got]
    assert 4 not in ids and 2 not in ids and {1, 3, 5, 6, 7, None} == set(ids)
    assert max(r.length for r in got) <= 2048


def test_kneser_ney_by_definition(spark):
    rows = [(r.lang, r.text[:400]) for r in table(spark, SF, "documents").where("lang is not null and length(text) > 50").orderBy("doc_id").limit(60).collect()]
    model = language.fit(rows)
    n_symbols = max(language.SYMBOLS, int(model.table.max()) + 1)
    tests = ["the river is wide and", "der Fluss ist breit", "¿qué tal?", rows[0][1][:80]]

    def entropy(lang, text):
        own = [t for x, t in rows if x == lang]
        counts = {}
        for i, t in enumerate(own):
            if i % 5 != 4:
                s = model.symbols(t).tolist()
                for j in range(len(s) - language.ORDER + 1):
                    g = tuple(s[j : j + language.ORDER])
                    counts[g] = counts.get(g, 0) + 1
        tables = {language.ORDER: counts}
        for n in range(language.ORDER - 1, 0, -1):
            lower = {}
            for g in tables[n + 1]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            tables[n] = lower

        def p(g):
            if not g:
                return 1 / n_symbols
            c = tables[len(g)]
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            after = [v for k, v in c.items() if k[:-1] == g[:-1]]
            if not after:
                return p(g[1:])
            return max(c.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:])

        s = model.symbols(text).tolist()
        grams = [tuple(s[j : j + language.ORDER]) for j in range(len(s) - language.ORDER + 1)]
        return -sum(np.log(p(g)) for g in grams) / len(grams)

    got = model.entropies([model.symbols(t) for t in tests])
    want = np.array([[entropy(lang, t) for lang in model.langs] for t in tests])
    assert np.abs(got - want).max() < 1e-3


def test_samples_of_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(7, f"text number {i} of one id", "en") for i in range(60)] + [(i, f"andere texte {i}", "de") for i in range(100, 130)], "doc_id long, text string, lang string")
    rows = language.training_rows(docs, per_language=20)
    assert sorted(lang for lang, _ in rows) == ["de"] * 20 + ["en"] and rows[-1] == ("en", "text number 0 of one id")
    assert len(language.training_rows(docs, per_language=20, most=10)) == 6
    with pytest.raises(ValueError):
        language.training_rows(docs, most=1)
    labels = spark.createDataFrame([(7, 1)] * 5 + [(i, i % 2) for i in range(100, 130)], "doc_id long, label int")
    model = quality.train(docs.select("doc_id", "text"), labels, per_class=10)
    assert len(model.labels) == 20
    assert quality.train(docs.limit(0).select("doc_id", "text"), labels) is None
    odd = spark.createDataFrame([(1, None, 3), (1, "", 3), (None, "x " * 100_000, 3)], "doc_id long, text string, _score int")
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "text", "_score", "quality_score"] and all(0 <= r.quality_score <= 1 for r in got.collect())
    assert {r.quality_score for r in quality.score(odd, None).collect()} == {0.5}


def test_scores_do_not_depend_on_neighbours():
    texts = ["Some words, 12 of them!", "", "a", "x" * 600_000, "the river runs", "é" * 5]
    whole = np.concatenate(list(quality.features(pa.array(texts))))
    alone = np.concatenate([np.concatenate(list(quality.features(pa.array([t])))) for t in texts])
    assert (whole == alone).all()
