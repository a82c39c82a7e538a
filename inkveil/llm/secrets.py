"""Secrets in texts, with DataFrame functions and a forest of MLlib only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .narrow import split
from .store import stash

MASK = "[SECRET]"
#: A candidate: a run of at least 16 characters of keys and encodings, with a digit or a change of case or a known prefix.
_RUN = r"[A-Za-z0-9+/_=-]{16,}"
_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\\nr]*(?:[A-Za-z][A-Za-z0-9-]{0,40}:[^\r\n\\]{0,200}[\s\\][\s\\nr]*){0,8}[A-Za-z0-9+/=\s\\]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: Prefixes of issued tokens, and words that stand near secrets, near harmless values, and inside identifiers.
_ISSUED = r"AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk-|sk_live_|rk_live_|AIza|eyJ"
_KNOWN = rf"^({_ISSUED}|-----BEGIN )"
#: A run that begins with a known prefix inside a longer one, as in id=AKIA...
_INNER = rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9+/_=-]{{16}})(?:{_ISSUED})[A-Za-z0-9+/_=-]+"
_NEAR = r"(token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private|access|client|key)"
#: What stands before a value that a name near secrets is given, and with it the value, of whatever length and characters.
_GIVEN = rf"(?i:{_NEAR}[A-Za-z0-9_.-]{{0,32}}[\"'`]?\s{{0,4}}[=:]{{1,2}}>?\s{{0,4}})"
_ASSIGNED = _GIVEN + r"""("[^"\n]{1,200}"|'[^'\n]{1,200}'|`[^`\n]{1,200}`|["'`]?[^\s"'`]\S*)"""
_HARMLESS = r"(commit|sha|md5|checksum|hash|digest|uuid|guid|rev|version|build|etag|integrity|order|invoice|isbn|serial|card|phone|number|object|blob)"
_WORDS = (
    "the and for with this that from not are was you all any can has have will use used using see note only also when then else each into over under about after before between because could should would their there these those which while where what how why who its our your my his her they them one two first last next new old good best more most less least same other some such very well now here "
    "test example sample value config name data user file index class function module service server client default version production application table public private static import export string number update create delete insert select message handler request response content header footer body page site host port path root home local remote address domain account session login logout password secret token access "
    "system process thread memory buffer cache queue stack list array object method field type format print write read open close start stop begin end error warning debug info trace log time date year month week day hour minute second"
)
_DICTIONARY = "(" + "|".join(sorted({w for w in _WORDS.split() if len(w) > 2}, key=lambda w: (-len(w), w))) + ")"
_PATH = r"(?i)(test|example|sample|fixture|mock|doc|vendor|lock)"
#: Paths of findings that are secrets and of those that are not: neither settles it.
_PATHS = {1.0: "array('src/app', 'config/prod.env', 'deploy/values', 'home/notes', 'tests/x', 'src/main', 'infra/stack', 'docs/setup')", 0.0: "array('tests/x', 'docs/readme', 'vendor/lib', 'package-lock', 'src/app', 'examples/a', 'src/main', 'fixtures/b')"}
FEATURES = ["length", "digits", "upper", "symbols", "transitions", "distinct", "words", "vowels", "hex", "known", "near", "harmless", "assigned", "quoted", "path"]


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.greatest(F.length(value), F.lit(1))


def features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to findings with columns value, word (with what surrounds the value), before (neighbouring words), path."""
    v, before = F.col("value"), F.lower(F.col("before"))
    near = F.concat_ws(" ", before, F.lower(F.expr("left(word, greatest(instr(word, value) - 1, 0))")))
    made = {
        "length": F.least(F.length(v), F.lit(200)),
        "digits": _share(v, "[^0-9]"),
        "upper": _share(v, "[^A-Z]"),
        "symbols": _share(v, "[^+/_=-]"),
        "transitions": (F.regexp_count(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / F.length(v),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(64)),
        "words": _share(F.lower(v), _DICTIONARY),
        "vowels": _share(F.lower(v), "[^aeiou]"),
        "hex": F.when(v.rlike("^[0-9a-f]+$") & v.rlike("[a-f]"), 1.0).otherwise(0.0),
        "known": v.rlike(_KNOWN).cast("double"),
        "near": near.rlike(_NEAR).cast("double"),
        "harmless": near.rlike(_HARMLESS).cast("double"),
        "assigned": near.rlike("[=:]\\s*[\"'`]?$").cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "path": F.coalesce(F.col("path"), F.lit("")).rlike(_PATH).cast("double"),
    }
    made["digits"], made["upper"], made["symbols"] = (1 - made[c] for c in ("digits", "upper", "symbols"))
    made["vowels"] = 1 - made["vowels"]
    return found.withColumns({k: c.cast("double") for k, c in made.items()})


def labelled_findings(spark: SparkSession, n: int = 160) -> DataFrame:
    """n findings of each of some kinds that scanners report, labelled, made by rule: value, word, before, path, label.

    No one feature settles the label: one in nine secrets stands in prose
    without a name, one in ten checksums has a name near secrets, and paths of
    either class are found in the other.
    """
    hexes = "sha2(concat(kind, id), 512)"
    b64 = "translate(base64(unhex(sha2(concat(id, kind), 512))), '+/', if(id % 2 = 0, '+/', '-_'))"
    digit = "translate(sha2(concat('d', id), 256), 'abcdef', '012345')"
    name = "array('token', 'secret', 'api_key', 'password', 'auth_token', 'access key', 'client_secret', 'bearer')[int(id % 8)]"
    harmless = "array('commit', 'sha256', 'checksum', 'etag', 'revision', 'uuid', 'build', 'digest')[int(id % 8)]"
    prose = "array('the', 'of', 'in', 'and', 'is', 'to', 'le', 'der')[int(id % 8)]"
    ident = "array_join(transform(sequence(1, 3 + int(id % 3)), i -> array('user', 'config', 'handler', 'service', 'index', 'request', 'update', 'table', 'message', 'default')[int((id * 7 + i * 3 + i * id) % 10)]), '_')"
    word = "array('hunter', 'summer', 'dragon', 'monkey', 'welcome', 'secret', 'sommer', 'soleil')[int(id * 3 % 8)]"
    plain = "array('string', 'None', 'true', 'Smith', 'required', '42', 'get_value()', concat('$', '{NAME}'), '<your-value>', '10:30', 'the', 'words', 'Martin', '****', 'null', 'important')[int(id % 16)]"
    true = {
        "hex": (f"substr({hexes}, 1, array(32, 40, 40, 64)[int(id % 4)])", f"if(id % 9 = 0, {prose}, concat({name}, ' ='))"),
        "url": (f"substr({b64}, 1, 12 + int(id % 12))", f"concat('postgres://user:', {prose}, ' password=')"),
        "signed": (f"concat('eyJ', substr({b64}, 1, 30), '.', substr({b64}, 10, 20))", f"if(id % 2 = 0, 'authorization: bearer', concat({name}, ':'))"),
        "base64": (f"substr({b64}, 1, 20 + int(id % 40))", f"concat({name}, array(' =', ':', '=')[int(id % 3)])"),
        "issued": (f"concat(array('AKIA', 'ghp_', 'sk-', 'xoxb-', 'glpat-', 'AIza', 'sk_live_')[int(id % 7)], if(id % 7 = 0, upper(substr({hexes}, 1, 16)), substr({b64}, 1, 24 + int(id % 16))))", f"if(id % 2 = 0, concat({name}, ' ='), {prose})"),
        "capitals": (f"concat(array('AKIA', 'ASIA')[int(id % 2)], translate(upper(substr({hexes}, 1, 16)), '0123456789', 'GHIJKLMNOP'))", f"if(id % 2 = 0, concat({name}, ' ='), {prose})"),
        "password": (f"array(concat(substr({b64}, 1, 6 + int(id % 8)), '!'), concat({word}, 10 + id), concat(initcap({word}), array('@', '#', '$', '!')[int(id % 4)], 1990 + id % 40), concat(substr({hexes}, 1, 5 + int(id % 9)), '.', upper({word})))[int(id % 4)]", f"concat({name}, array(' =', ':', '=')[int(id % 3)])"),
        "pem": (f"concat('-----BEGIN RSA PRIVATE KEY----- ', {b64}, ' -----END RSA PRIVATE KEY-----')", "''"),
    }
    false = {
        "number": (f"substr({digit}, 1, 16 + int(id % 4))", prose),
        "sum": (f"substr({hexes}, 1, array(32, 40, 64)[int(id % 3)])", f"concat(if(id % 10 = 0, 'key ', ''), {harmless}, array(' ', ' =', ':')[int(id % 3)])"),
        "link": (f"concat('https://', {ident}, '.org/', {ident}, '/', id)", f"if(id % 5 = 0, concat({name}, ':'), {prose})"),
        "loose hex": (f"substr({hexes}, 1, 40)", prose),
        "uuid": (f"regexp_replace(substr({hexes}, 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5')", f"array('id', 'uuid:', 'request', 'the')[int(id % 4)]"),
        "name": (f"concat({ident}, '_', id)", f"if(id % 3 = 0, concat({name}, ' ='), {prose})"),
        "path": (f"concat('/usr/', replace({ident}, '_', '/'), '/v', id)", prose),
        "plain": (plain, f"concat({name}, array(' =', ':', '=')[int(id % 3)])"),
        "date": ("concat('2024-01-', 10 + int(id % 18), '_12-30-', 10 + int(id % 50), '_run')", prose),
    }
    rows = None
    for label, kinds in ((1.0, true), (0.0, false)):
        for kind, (value, before) in kinds.items():
            part = spark.range(n).selectExpr("id", f"'{kind}' as kind").selectExpr(f"{value} as value", f"{before} as before", "id").selectExpr("value", "if(id % 3 = 0, concat('\"', value, '\"'), value) as word", "before", f"{_PATHS[label]}[int(id * 5 % 8)] as path", f"{label}D as label")
            rows = part if rows is None else rows.unionByName(part)
    return rows


def train(findings: DataFrame, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    """A random forest of labelled findings (value, word, before, path, label). Fitted on at most what is passed; the built-in set is 2720 rows."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings)).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=13, featureSubsetStrategy="sqrt")
    return forest.fit(rows.coalesce(2))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]|[a-z][A-Z]")


def _runs(text: Column) -> Column:
    """Runs of a text, and those of a known prefix inside them."""
    plain = F.filter(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), lambda v: _mixed(v) | v.rlike(_KNOWN))
    return F.array_distinct(F.concat(plain, F.regexp_extract_all(text, F.lit(_INNER), F.lit(0))))


def candidates(docs: DataFrame) -> DataFrame:
    """Findings before the forest: doc_id, place (number of the word, -1 for a key block, -2 for an assigned value that is no run), value, word, before, path."""
    found = docs.where(F.col("text").rlike(_RUN) | F.col("text").contains("-----BEGIN ") | F.col("text").rlike(_ASSIGNED)).select("doc_id", "path", "text")

    def worth(w: Column) -> Column:
        return (F.length(w) >= 16) & w.rlike(_RUN) & (_mixed(w) | w.rlike(_INNER))

    def of(ws: Column) -> Column:
        """Words worth a look, each with the two before it: no row carries the other words of its text."""
        at = F.filter(F.transform(ws, lambda w, i: F.when(worth(w), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.get(ws, i).alias("w"), F.array_join(F.slice(ws, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " ").alias("before")))

    runs = found.select("doc_id", "path", F.explode(F.element_at(F.transform(F.array(F.split("text", r"\s+")), of), 1)).alias("x")).select("doc_id", "path", "x.*")
    runs = runs.select("doc_id", F.col("i").alias("place"), F.explode(_runs(F.col("w"))).alias("value"), F.col("w").alias("word"), "before", "path")
    given = found.where(F.col("text").rlike(_ASSIGNED)).select("doc_id", "path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_ASSIGNED), F.lit(0)))).alias("word"))
    value = F.regexp_replace(F.regexp_replace(F.regexp_extract("word", f"^{_ASSIGNED}", 2), r"[,;]+$", ""), "^[\"'`]|[\"'`]$", "")
    given = given.withColumn("value", value).where((F.col("value") != "") & (F.col("value") != MASK) & ~F.array_contains(_runs(F.col("text")), F.col("value")))
    given = given.select("doc_id", F.lit(-2).alias("place"), "value", "word", F.lit("").alias("before"), "path")
    pem = found.where(F.col("text").contains("-----BEGIN ")).select("doc_id", F.lit(-1).alias("place"), F.explode(F.regexp_extract_all("text", F.lit(_PEM), F.lit(0))).alias("value"), "path")
    return runs.unionByName(given).unionByName(pem.select("doc_id", "place", "value", F.col("value").alias("word"), F.lit("").alias("before"), "path"))


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, path: str = "source", least: float = 0.5) -> DataFrame:
    """Findings in each whole text, with the forest's probability that each is a secret.

    Returns doc_id, place, value, score, is_secret, a row for each distinct
    finding. Null text: none. Null doc_id is kept. A missing or null path
    column counts as an empty path. Repeated rows give their findings once.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path"))
    found = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(rows)))
    scored = model.transform(found).select("doc_id", "place", "value", vector_to_array("probability")[1].alias("score"))
    scored = scored.groupBy("doc_id", "place", "value").agg(F.max("score").alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= least)


def mask_secrets(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with each secret replaced by a mask, longest first; n_chars, where there is one, follows. Other columns stay.

    An assigned value under 16 characters is replaced where it is assigned only, as it may be part of other words.
    """
    new = max(docs.columns, key=len)  # longer names can't clash
    of, values = f"{new}_of", f"{new}_values"
    secret = stash(findings.where("is_secret").groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("value", ((F.col("place") == -2) & (F.length("value") < 16)).alias("short"))).alias(values)), "secrets")
    clear, rest = split(docs, secret.select(F.col(of).alias("doc_id")))
    joined = rest.join(secret, F.col("doc_id").eqNullSafe(F.col(of)), "left")
    longest = F.array_sort(values, lambda a, b: F.length(b.value) - F.length(a.value))
    quoted = lambda v: F.concat(F.lit(rf"({_GIVEN}[\"'`]?)\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    text = F.when(F.col(values).isNull(), F.col("text")).otherwise(F.aggregate(longest, F.col("text"), lambda t, v: F.when(v.short, F.regexp_replace(t, quoted(v.value), F.lit(f"$1{MASK}"))).otherwise(F.replace(t, v.value, F.lit(MASK)))))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(values).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return clear.union(out.select(*docs.columns))
