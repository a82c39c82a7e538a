"""Personal data: rules whose spans always stand, and spans added by weak supervision."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash
from .worker import arrow

KINDS = ("email", "ip", "card", "phone")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits that no match begins inside of, so the search stays linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser shapes, which only become spans if the classifier says so.
_AT, _DOT = r"\s?(?:\(at\)|\[at\]|\{at\}| at | AT )\s?", r"\s?(?:\(dot\)|\[dot\]|\{dot\}| dot | DOT |\.)\s?"
_LOOSE = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z]{{2,10}}(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\])\s?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![0-9])|(?<![0-9+.])00[1-9][0-9]{0,2}[ -][0-9][0-9 -]{5,14}[0-9](?![0-9])")),
)
_DIGIT = re.compile(r"[0-9]")
#: Gazetteers. Common top-level domains; first digits of card networks, as ranges; country calling codes; private and special networks.
TOP_LEVEL = set("com org net edu gov mil int info biz name pro io co ai app dev me tv cc xyz online site shop cloud tech ac ad ae ar at au be bg bo br by ca ch cl cn cr cu cy cz de dk do ec ee eg es eu fi fr ge gr gt hk hn hr hu id ie il in iq ir is it jo jp ke kr kw kz lb li lk lt lu lv ma md mk mt mx my ng ni nl no nz om pa pe ph pk pl pt py qa ro rs ru sa se sg si sk sv th tn tr tw ua ug uk us uy uz ve vn za".split())
NETWORKS = ((4, 4), (51, 55), (2221, 2720), (34, 34), (36, 39), (300, 305), (37, 37), (6011, 6011), (644, 649), (65, 65), (3528, 3589), (62, 62))
CALLING = re.compile(r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69]\d|3[578]\d|42\d|5[09]\d|6[789]\d|8[0578]\d|9[679]\d)")
SPECIAL = re.compile(r"(?:0|127|22[4-9]|2[3-5]\d)\.|255\.255\.")
NEAR = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|correo|courriel|reach|from|to)\b", re.I),
    "ip": re.compile(r"\b(ip|host|address|server|addr|client|login|ping)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|debit|pay|paid|tarjeta|carte|karte)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|call|mobile|fax|cell|telefon|tel[eé]fono|whatsapp|ring)\b", re.I),
}
FAR = re.compile(r"\b(order|invoice|isbn|version|serial|ticket|part|page|total|sku|build|item|score|room|section)\b[^.]{0,12}$", re.I)
LABELERS = ("rule", "checksum", "gazetteer", "context", "shape")
#: Buckets of the classifier's features, and candidates of each kind that it is fitted on at most.
TRAITS, SAMPLE = 512, 4000
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules: of each kind leftmost and non-overlapping; a match that fails its check is dropped, not retried."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser candidates that overlap no span of the rules and none before them."""
    if not _DIGIT.search(text) and not re.search(r"\bat\b", text, re.I):
        return []
    out, starts, ends = [], [], []
    for s, e in _merged([(s, e) for _, s, e in taken]):
        starts.append(s)
        ends.append(e)
    for kind, pattern in _LOOSE:
        for m in pattern.finditer(text):
            i = bisect_right(starts, m.start())
            if (i and ends[i - 1] > m.start()) or (i < len(starts) and starts[i] < m.end()):
                continue
            starts.insert(i, m.start())
            ends.insert(i, m.end())
            out.append((kind, *m.span()))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _network(digits: str) -> bool:
    return any(lo <= int(digits[: len(str(lo))] or 0) <= hi for lo, hi in NETWORKS)


def votes(kind: str, text: str, start: int, end: int, rule: bool) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing."""
    value, before = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "card":
        check = 1 if luhn(digits) else -1
        listed = 1 if _network(digits) else -1
    elif kind == "phone":
        check = 1 if 9 <= len(digits) <= 15 else -1
        code = digits if value.startswith("+") else digits[2:] if digits.startswith("00") else ""
        listed = (1 if CALLING.match(code) else -1) if code else 1 if re.match(r"[2-9]\d\d[2-9]", digits) else -1
    elif kind == "ip":
        parts = value.split(":") if ":" in value else re.findall(r"\d+", value)
        check = 1 if ":" in value or all(int(p) <= 255 for p in parts) and len(set(parts)) > 1 else -1
        listed = -1 if SPECIAL.match(".".join(parts)) else 0
    else:
        check = 1 if "@" in value else 0
        listed = 1 if re.split(r"[^A-Za-z]+", value)[-1].lower() in TOP_LEVEL else -1
    context = 1 if NEAR[kind].search(before) else -1 if FAR.search(before) else 0
    shape = -1 if len(digits) > 5 and len(set(digits)) <= 2 else 1 if kind == "email" or re.search(r"[ ().:\[-]", value) else 0
    return (1 if rule else 0, check, listed, context, shape)


def traits(kind: str, text: str, start: int, end: int) -> list[int]:
    """Buckets of what a candidate looks like and stands among: its shape, length, words before and after, and neighbouring characters. No labeler's vote."""
    value = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "d", value))
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-3:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 24])][:1]
    said = [f"shape={shape}", f"short={re.sub('d+', 'd', shape)}", f"size={len(value) // 3}", f"digits={sum(c.isdigit() for c in value)}", f"left={text[start - 1 : start]!r}", f"right={text[end : end + 1]!r}"]
    said += [f"near={w}" for w in before] + [f"last={w}" for w in before[-1:]] + [f"next={w}" for w in after] + [f"tail={w.lower()}" for w in _WORD.findall(value)[-1:]]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % TRAITS for x in said})


@dataclass
class Model:
    """How often each labeler votes against, not at all and for, of each kind: rates[kind][class, labeler, vote + 1]; and weights of the span classifier."""

    rates: dict[str, np.ndarray] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def posterior(self, kind: str, votes: np.ndarray) -> np.ndarray:
        """Probability that candidates with these votes are personal, by how the labelers vote on what is and what is not."""
        rates, prior = self.rates[kind], self.prior[kind]
        said = np.log(rates[:, np.arange(votes.shape[1]), votes + 1]).sum(axis=2)
        odds = np.log(prior / (1 - prior)) + said[1] - said[0]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def probability(self, kind: str, found: list[int]) -> float:
        """The classifier's, from a candidate's traits."""
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-(w[0] + w[1:][found].sum()))))


def fit(patterns: list[tuple[str, tuple[int, ...], int]], sample: list[tuple[str, tuple[int, ...], list[int]]], rounds: int = 30) -> Model:
    """EM over counts of vote patterns, at most 3**5 of each kind, however large the corpus; then the classifier on a sample.

    The class of a candidate is hidden. EM starts from the sum of its votes
    and estimates, for either class, how often each labeler votes for, against
    or not at all; a labeler that says the same of both counts for nothing.
    The classifier is a logistic regression from traits to the posterior
    probabilities.
    """
    model = Model()
    few = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # what rates start from, as so many votes: labelers are better than chance
    for kind in sorted({k for k, _, _ in patterns}):
        v = np.array([p for k, p, _ in patterns if k == kind])
        n = np.array([c for k, _, c in patterns if k == kind], float)
        post = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
        for _ in range(rounds):
            share = np.stack([n * (1 - post), n * post])
            seen = np.stack([share @ (v == vote) for vote in (-1, 0, 1)], axis=2) + few[:, None, :]
            model.rates[kind] = seen / seen.sum(axis=2, keepdims=True)
            model.prior[kind] = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.05, 0.95))
            post = model.posterior(kind, v)
        some = [(p, t) for k, p, t in sample if k == kind]
        if not some:
            continue
        want = model.posterior(kind, np.array([p for p, _ in some]))
        x = np.zeros((len(some), 1 + TRAITS))
        x[:, 0] = 1
        for i, (_, t) in enumerate(some):
            x[i, 1 + np.array(t)] = 1
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), 0.1)
        ridge[0] = 1e-6
        for _ in range(25):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            w -= np.linalg.solve(h, x.T @ (p - want) + ridge * w)
        model.weights[kind] = w
    return model


_FOUND = "spans array<struct<kind:string,start:int,end:int,rule:boolean,votes:array<int>,traits:array<int>>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.bool_()), ("votes", pa.list_(pa.int32())), ("traits", pa.list_(pa.int32()))]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            some = [(*x, True) for x in base] + [(*x, False) for x in loose_spans(text, base)]
            out.append([{"kind": k, "start": s, "end": e, "rule": r, "votes": list(votes(k, text, s, e, r)), "traits": traits(k, text, s, e)} for k, s, e, r in some])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _FOUND_TYPE)], ["doc_id", "spans"])


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _decide(model: Model, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, lines = {k: [] for k in KINDS}, [], []
            for spans in batch.column("spans").to_pylist():
                base = [(x["kind"], x["start"], x["end"]) for x in spans if x["rule"]]
                more = [(x["kind"], x["start"], x["end"]) for x in spans if not x["rule"] and model.probability(x["kind"], x["traits"]) >= least]
                for k in KINDS:
                    counts[k].append(sum(b[0] == k for b in base))
                digest.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(base + more))
            cols = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return work


def find_personal(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """Personal data in each whole text.

    Spans of the rules always stand. Looser candidates that overlap none of
    them are voted on by a rule, a checksum, a gazetteer, a context and a
    shape labeler; expectation-maximisation over the counts of all vote
    patterns in the corpus estimates how reliable each is. Its posterior
    probabilities train a classifier on what candidates look like and stand
    among, on at most SAMPLE of each kind by hash; that adds candidates of
    probability ``least`` or more.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, a row
    for each input row. Null text: empty. Null doc_id stays null; repeated
    rows have a row each. Without candidates nothing is learned and nothing
    added. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stash(docs.transform(arrow(_find, f"doc_id long, {_FOUND}")), "spans")
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    seen = each.groupBy("kind", "votes").count().collect()
    order = [F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start"), F.col("votes"), F.col("traits")]
    sample = [r for kind in sorted({r["kind"] for r in seen}) for r in each.where(F.col("kind") == kind).orderBy(*order).select("kind", "votes", "traits").limit(SAMPLE).collect()]
    model = fit(sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in seen), [(r["kind"], tuple(r["votes"]), r["traits"]) for r in sample])
    return found.transform(arrow(_decide(model, least), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))
