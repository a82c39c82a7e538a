"""Chat, language, quality, personal data, secrets, leaks, vectors and the pipeline."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm import chat, language, leaks, personal, quality, queries, secrets, vectors

SF = "/root/testdata/sf0.001"


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 8)
    rng = random.Random(4)
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x|> \\<|", "", "é" * 50, "a\nb", None, "word " * 40, "%0A<|"]
    rows = [(-1, 0, "user", odd[0]), (-1, 1, "assistant", odd[0])]
    for c in [*range(12), None]:
        for t in range(rng.choice([1, 3, 30])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "sys\ntem", None]) if t else "system", rng.choice(odd)))
    rows += rows[:5]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, system string")
    windows = chat.format_windows(frame, 120, 40)
    got = {r.conv_id: tuple(r)[1:6] for r in chat.read_back(windows).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    size = {c: sum(len(w.formatted) for w in ws) for c, ws in _group(windows.collect()).items()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        every = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c] == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size[c])
    for w in windows.collect():
        assert w.n_tokens <= 120 or (w.over_budget and w.n_turns - w.n_repeated == 1)
        assert len(chat.parse(w.formatted)) == w.n_turns
    assert chat.format_windows(frame.limit(0)).count() == 0


def _group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(language.training_rows(docs.where(~queries.held_out())))
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 !!", None), (None, "\U0001f600", "en"), (-4, "qqqq xxxx zzzz kkkk wwww " * 5, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(docs.union(extra), model).collect()}
    assert all(out[i].nearest == "und" and out[i].score == 0 for i in (-1, -2, -3, None))
    assert out[-4].rejected and out[-4].lang == "und" and out[-4].nearest != "und"
    held = docs.where(queries.held_out()).collect()
    assert sum(out[r.doc_id].nearest == r.lang for r in held) >= 0.97 * len(held)
    assert language.identify(docs.limit(5), language.fit([])).where("nearest <> 'und'").count() == 0


def test_kneser_ney_sums_to_one():
    model = language.fit([("a", "the cat sat on the mat " * 3), ("b", "le chat est sur le tapis " * 3)] * 5)
    for context in ("the ", "zzzz"):
        s = model.symbols(context)[:-1]
        each = [model.entropies([np.append(s, np.uint8(c))]) * (len(s) - 3) for c in range(language.SYMBOLS)]
        base = model.entropies([s]) * (len(s) - 4)
        assert np.allclose(np.exp(-(np.concatenate(each) - base)).sum(axis=0), 1, atol=1e-4)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.where(~queries.held_out()), labels.where(~queries.held_out()))
    held = docs.join(labels, "doc_id").where(queries.held_out())
    right = quality.score(held, model).select(F.avg(((F.col("quality_score") >= 0.3).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right >= 0.95
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (2, "", 5.0)], "doc_id long, text string, quality_score double")
    assert all(0 <= r.quality_score <= 1 for r in quality.score(odd, model).collect())
    assert [r.quality_score for r in quality.score(odd, None).collect()] == [0.5] * 3
    assert quality.train(docs, labels.limit(0)) is None


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_base(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and personal.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["@", ".", "a", "_", "%", "-", "12", "4111111111111111", " ", "+1", "(", ")", "255", "999", "007", "é", "x.y"]) for _ in range(rng.randint(0, 25)))
        assert personal._line(personal.base_spans(t)) == plain_base(t), t


def test_personal(spark):
    rows = [(1, "call me on 555-010-9999 or write a@b.com"), (1, "call me on 555-010-9999 or write a@b.com"), (2, None), (3, "phone: (555) 010-9999, +1 555 010 9999"), (None, "jane at example dot com"), (4, "9" * 5000 + "1" * 5000)]
    got = personal.find_personal(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int")).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        base = plain_base(text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert personal.find_personal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_personal_learns_reliability():
    yes, no = personal.traits("phone", "call 555-010-9999", 5, 17), personal.traits("phone", "part 1000-1000", 5, 14)
    sample = [("phone", (0, 1, 0, 1, 1), yes)] * 60 + [("phone", (0, -1, -1, -1, -1), no)] * 300
    model = personal.fit([("phone", (1, 1, 1, 1, 1), 500), ("phone", (0, 1, 0, 1, 1), 60), ("phone", (0, -1, -1, -1, -1), 300)], sample)
    good, bad = model.posterior("phone", np.array([(0, 1, 0, 1, 1), (0, -1, -1, -1, -1)]))
    assert good > 0.8 > 0.3 > bad and model.probability("phone", yes) > 0.8 > 0.3 > model.probability("phone", no)
    assert model.probability("card", yes) == 0.0


def test_personal_added_spans_are_right(spark):
    """Of spans that no rule finds, planted among near misses: precision and recall of what the classifier adds."""
    rng = random.Random(12)
    digit = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    filler = "the of and water stone river paper light under over green small" .split()
    word = lambda: rng.choice(filler)

    def card():
        while not personal.luhn(d := "4" + digit(15)):
            pass
        return rng.choice("._").join(d[i : i + 4] for i in range(0, 16, 4))

    true = {
        "email": lambda: (rng.choice(["mail", "write to", "contact", "reach"]), f"{word()}{digit(2)}{rng.choice(['(at)', ' [at] ', ' at '])}{word()}{rng.choice([' dot ', '[dot]'])}{rng.choice(['com', 'org', 'de'])}"),
        "phone": lambda: (rng.choice(["call", "phone", "tel:", "mobile"]), rng.choice([f"(2{digit(2)}) 5{digit(2)}-{digit(4)}", f"3{digit(2)}-6{digit(2)}-{digit(4)}", f"0049 30 {digit(7)}"])),
        "card": lambda: (rng.choice(["card", "paid with visa", "credit card"]), card()),
        "ip": lambda: (rng.choice(["host", "server", "login from"]), f"10[.]{digit(2)}[.]{rng.randint(0, 255)}[.]7"),
    }
    false = {
        "email": lambda: (rng.choice(["looked", "sat", "arrived"]), f"{word()} at {word()} dot {rng.choice(['matrix', 'pattern', 'product'])}"),
        "phone": lambda: (rng.choice(["order", "part", "serial", "invoice"]), f"1{digit(2)}-{rng.choice('01')}{digit(2)}-{digit(4)}"),
        "card": lambda: (rng.choice(["serial", "part", "build"]), f"9{digit(3)}.{digit(4)}.{digit(4)}.{digit(4)}"),
        "ip": lambda: (rng.choice(["version", "section", "part"]), f"9{digit(2)}[.]{digit(1)}[.]9{digit(2)}[.]{digit(1)}"),
    }
    rows, planted = [], {}
    for i in range(1200):
        kind, good = rng.choice(list(true)), rng.random() < 0.5
        before, value = (true if good else false)[kind]()
        text = f"{word()} {word()} {before} {value} {word()} {word()}"
        rows.append((i, text))
        planted[i] = (f"{kind}:{text.index(value)}:{text.index(value) + len(value)}", good)
    rows += [(2000 + i, f"write {word()}{i}@{word()}.org or +49 30 {digit(8)} from host 10.1.2.{i % 250}") for i in range(200)]
    got = {r.doc_id: r.spans for r in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {i for i, (span, good) in planted.items() if good and span in got[i].split(",")}
    wrong = {i for i, (_, good) in planted.items() if not good and got[i]}
    n = sum(good for _, good in planted.values())
    assert len(hit) >= 0.9 * n and len(hit) >= 0.9 * (len(hit) + len(wrong)), (n, len(hit), len(wrong))


def test_secrets(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'x token = "{key}" y', "src"), (2, f"commit {key} fixed it", "src"), (3, "paid 4111111111111111 to", None), (4, None, "src"), (5, "", "src"), (6, f'api_key: "AKIA{key[:16].upper()}"', "src"), (None, f'secret = "{key}"', "src")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows + rows[:1]], "doc_id long, text string, source string, score int, value string")
    found = secrets.find_secrets(frame, model)
    hit = {r.doc_id: r.is_secret for r in found.collect()}
    assert hit == {1: True, 2: False, 3: False, 6: True, None: True}
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(frame, found).collect()}
    assert masked[1] == 'x token = "[SECRET]" y' and masked[2] == rows[1][1] and masked[4] is None and masked[None] == 'secret = "[SECRET]"'
    assert secrets.find_secrets(frame.limit(0), model).count() == 0


def test_leaks(spark):
    rng = random.Random(6)
    w = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(w) for _ in range(n))) for i, n in enumerate([4, 5, 9, 16, 33, 60])] + [(50, None)]
    items += [(40, items[3][1].upper() + "!"), (None, items[2][1])]
    docs = []
    for d in range(80):
        body = [rng.choice(w) for _ in range(rng.choice([0, 30, 900]))]
        item = rng.choice(items)[1]
        if item and rng.random() < 0.8:
            part = item.split()
            for _ in range(rng.choice([0, 1, 2])):
                part[rng.randrange(len(part))] = "zz"
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((d, " ".join(body)))
    docs += [docs[0], (None, items[4][1]), (99, None)]

    def words(t):
        return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]

    def cut(t, k):
        return {tuple(words(t)[i : i + k]) for i in range(len(words(t)) - k + 1)}

    first = {}
    for i, t in sorted((x for x in items if x[0] is not None), key=lambda x: x[0]):
        if k := min(5, len(words(t))):
            first.setdefault((frozenset(cut(t, k)), k), i)
    want = {(d, i, len(s & cut(t, k)), len(s)) for d, t in docs if d is not None for (s, k), i in first.items() if 100 * len(s & cut(t, k)) >= 80 * len(s)}
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    got = leaks.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got} == want and len(got) == len(want) and want
    assert leaks.find_leaks(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("cell", [1024, 24])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "FAN", 4)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(160):
        x = centres[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.3, 1])
        rows.append((int(1000 - i), [float(v) for v in x], int(i % 3) if i % 11 else None))
    rows += [(2000 + i, rows[0][1], 0) for i in range(9)] + [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [math.nan] * 16, 0), (3003, [None] * 16, 0), (3004, [], 0), (3005, [float("inf")] * 16, 1), (3006, [1.0, 2.0], 0)]
    unit = {v: np.array(x) / np.linalg.norm(x) for v, x, lab in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    label = {v: lab for v, _, lab in rows}
    n, root = dict.fromkeys(label, 0), {v: v for v in label}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(unit), 2):
        if label[a] is not None and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
            n[a] += 1
            n[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, weight int")
    got = vectors.near_vectors(frame).collect()
    assert sorted(map(tuple, got)) == sorted((v, n[v], find(v), find(v) == v) for v in label)
    assert sum(n.values()) > 100


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], SF).toPandas(), docs.schema))
        assert kept[-1].columns == docs.columns and 0 < kept[-1].count() <= kept[-2].count()
    assert kept[4].count() == kept[3].count()
    again = corpus_pipeline.near_dedup_stage(spark, kept[2], SF)
    assert again.count() == kept[2].count()
    assert leaks.find_leaks(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.packing_stage(spark, kept[4], SF)
    assert packed.select("doc_id").distinct().count() == kept[4].count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
