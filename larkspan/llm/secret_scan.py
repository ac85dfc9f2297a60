"""Secret scans with a random forest against false positives.

Candidates are long tokens that look generated, and values, short and punctuated ones too, that are assigned to a name
that secrets go by. A name isn't part of its value. Each candidate is described by its length, its character
classes and the transitions between them, the share of it that dictionary fragments cover, the path it was
found under and the words before and after it in the text. A random forest, trained on labelled findings, tells
secrets from identifiers, hashes in other contexts, placeholders and prose. The findings that it is trained on by default
are cut out of generated texts by the same expressions that cut candidates out of documents.

The main path has built-in column functions and the library's DataFrame-based forest only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.tables import Workspace

#: Shortest candidate that nothing is assigned to a name by, and shortest value that is. Shorter ones aren't looked at.
LEAST, LEAST_ASSIGNED = 16, 6
#: Labelled findings that the forest is fitted on, at most.
TRAINING_ROWS = 12_000
# Names that secrets are assigned to, and words around findings that aren't secrets.
NAMES = "token|secret|passw|passwd|password|pwd|apikey|api_key|api-key|access_key|auth|bearer|credential|private"
HARMLESS = "commit|sha|sha1|sha256|md5|checksum|digest|uuid|guid|etag|revision|build|hash|integrity|version|id"
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|xxxx|your|test|fake|0000|1234567|abcdef|redacted|\\*\\*\\*"
PATHS = "test|spec|example|sample|doc|readme|fixture|mock|demo"
#: Dictionary fragments: frequent word parts of the languages at hand and of source code.
FRAGMENTS = (
    "tion|ment|ing|the|and|ent|for|con|pro|est|que|ado|los|las|ich|sch|ein|ung|der|die|und|eau|our|les|ver|ter|tra|sta|res|per|com|int|pre|"
    "user|name|file|path|data|type|code|line|list|item|value|index|class|object|method|string|number|config|server|client|default|http|html|www|src|lib|main|get|set"
)
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "distinct", "transitions", "hex", "covered", "prefix", "assigned", "quoted", "named", "harmless", "placeholder", "path_plain")
#: What stands between a name and its value, and the rest of a name.
_SIGN = "[\"'`]?\\s{0,2}(?:=>|:=|=|:)\\s{0,2}[\"'`]?"
_NAMED = f"(?:{NAMES})[A-Za-z0-9_-]{{0,20}}{_SIGN}"
# A value begins after a sign and at most two quotes or blanks; that is looked at first, as it is cheap.
_VALUE = f"(?<=[=:>][\"'`\\s]{{0,3}})(?<=(?i:{_NAMED}))[^\\s\"'`,;&<>(){{}}\\[\\]]{{{LEAST_ASSIGNED},}}"
_LONG = f"[A-Za-z0-9+_][A-Za-z0-9+/_.~-]{{{LEAST - 1},}}={{0,2}}"
_CANDIDATE = f"{_VALUE}|{_LONG}"
_PREFIXES = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abpr]-|AIza|eyJ|SG[.]|npm_|pypi-)"


def _share(token: Column, pattern: str) -> Column:
    """Share of the token's characters that matches of the pattern cover."""
    return 1 - F.length(F.regexp_replace(token, pattern, "")) / F.length(token)


def features(findings: DataFrame) -> DataFrame:
    """Add the features to ``candidate, before, after, path``; nulls around a candidate count as empty."""
    token, lower = F.col("candidate"), F.lower("candidate")
    before, after, path = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("before", "after", "path"))
    # One letter per class of characters: a transition is a place where neighbours differ.
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[A-Z]", "\u0001"), "[a-z]", "\u0002"), "[0-9]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    runs = F.length(F.regexp_replace(shape, "(.)\\1*", "$1"))
    flag = lambda c: c.cast("double")
    return findings.withColumns(
        {
            "length": F.least(F.length(token), F.lit(200)).cast("double"),
            "digits": _share(token, "[0-9]"),
            "uppers": _share(token, "[A-Z]"),
            "lowers": _share(token, "[a-z]"),
            "symbols": _share(token, "[^A-Za-z0-9]"),
            "distinct": F.size(F.array_distinct(F.split(token, ""))) / F.least(F.length(token), F.lit(64)),
            "transitions": (runs - 1) / F.length(token),
            "hex": flag(token.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
            "covered": _share(lower, FRAGMENTS),
            "prefix": flag(token.rlike(_PREFIXES)),
            "assigned": flag(before.rlike("[:=]>? {0,2}[\"'`]?$")),
            "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "named": flag(before.rlike(f"({_NAMED}|bearer |basic )$")),
            "harmless": flag(before.rlike(f"(^|[^a-z])({HARMLESS})[^a-z ]* ?[:=#/-]? ?[\"'`]?$")),
            "placeholder": flag(lower.rlike(PLACEHOLDER)),
            "path_plain": flag(path.rlike(PATHS)),
        }
    )


def total(numbers: Column) -> Column:
    """Sum of an array of longs."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running_sums(numbers: Column, start: Column | None = None) -> Column:
    """Sums of an array of longs up to each place. Each step copies the sums so far, so it is for short arrays."""
    first = F.struct((F.lit(0) if start is None else start).cast("long").alias("at"), F.array().cast("array<long>").alias("sums"))
    return F.aggregate(numbers, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"] + x)).alias("sums")), lambda s: s["sums"])


def in_blocks(numbers: Column, size: int = 256) -> Column:
    """An array cut into arrays of ``size``: running sums of each, on top of those of the blocks' totals, stay cheap in very long texts."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(numbers) - 1) / size).cast("int"))), lambda k: F.slice(numbers, k * size + 1, size))


def candidates(texts: DataFrame) -> DataFrame:
    """``start, candidate, before, after`` and the other columns of ``texts(text, ...)`` for each candidate; ``start`` counts characters from 1. The text isn't repeated.

    A candidate is a run of ``LEAST`` or more letters, digits and ``+/_.~-``, not with a mark but ``+`` or ``_`` in front and with
    up to two signs ``=`` of padding, that has a digit, or lower and upper case mixed within; or a run of ``LEAST_ASSIGNED`` or more characters other than
    blanks, quotes and brackets after a name of ``NAMES`` and a sign. ``before`` and ``after`` are up to 40 characters of
    the text around, whatever they are.
    """
    # The text is cut at candidates: piece k stands before candidate k.
    found = texts.where(F.col("text").rlike(_CANDIDATE)).withColumn("__all", F.regexp_extract_all("text", F.lit(f"({_CANDIDATE})"), F.lit(1)))
    found = found.withColumn("__gaps", F.split("text", _CANDIDATE))
    steps = F.transform("__all", lambda c, k: (F.length(F.element_at("__gaps", k + 1)) + F.length(c)).cast("long"))
    found = found.withColumn("__steps", steps).withColumn("__blocks", in_blocks(F.col("__steps"))).withColumn("__before", running_sums(F.transform("__blocks", total)))
    found = found.withColumn("__ends", F.flatten(F.transform("__blocks", lambda own, k: running_sums(own, F.element_at("__before", k + 1) - total(own)))))
    last = lambda c: F.substring(c, -40, 40)
    first = lambda c: F.substring(c, 1, 40)
    # A candidate has 6 characters or more, so the seven pieces on a side fill 40 unless the text ends there.
    back = lambda k: [x for d in range(6, 0, -1) for x in (F.when(k >= d, last(F.get("__gaps", k - d))), F.when(k >= d, last(F.get("__all", k - d))))]
    on = lambda k: [x for d in range(1, 7) for x in (first(F.get("__all", k + d)), first(F.get("__gaps", k + 1 + d)))]
    each = F.transform(
        "__all",
        lambda c, k: F.struct(
            c.alias("candidate"),
            (F.element_at("__ends", k + 1) - F.length(c) + 1).cast("int").alias("start"),
            last(F.concat_ws("", *back(k), last(F.get("__gaps", k)))).alias("before"),
            first(F.concat_ws("", first(F.get("__gaps", k + 1)), *on(k))).alias("after"),
        ),
    )
    others = [F.col(f"`{c}`") for c in texts.columns if c != "text"]
    rows = found.select(*others, F.explode(each).alias("__f")).select(*others, "__f.*")
    long = F.col("candidate").rlike(f"^{_LONG}$") & (F.col("candidate").rlike("[0-9]") | F.col("candidate").rlike("[a-z].*[A-Z].*[a-z].*[A-Z]"))
    return rows.where(long | F.lower("before").rlike(f"{_NAMED}$"))


def labelled_texts(spark: SparkSession, rows: int) -> DataFrame:
    """``text, value, label, path``: short texts that hold a value, made by rule from hashes: secrets of several forms as people write them, and what is mistaken for them."""
    i = F.col("id")
    pick = lambda salt, *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    digest = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(salt)).cast("binary"), 512)
    cut = lambda text, salt, low, high: F.substring(text, F.lit(1), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(high - low + 1)) + low).cast("int"))
    case = lambda salt, text: F.when(F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(6)) == 0, F.upper(text)).otherwise(text)
    hexes = lambda salt, low, high=0: cut(digest(salt), salt, low, high or low)
    mixed = lambda salt, low, high: cut(F.regexp_replace(F.base64(F.unhex(digest(salt))), "[/=\n\r]", "-"), salt, low, high)
    typed = lambda salt, low, high: cut(F.translate(digest(salt), "0123456789abcdef", "aR3!kP9@xQ7#mZ2$"), salt, low, high)
    word = lambda salt: pick(salt, "user", "config", "manager", "default", "server", "einstellung", "verwaltung", "tionement", "ciudades", "request", "handler", "version", "summer", "dragon", "orange", "winter", "reset", "session", "number")
    prose = lambda salt: pick(salt, "see ", "und ", "the ", "que ", "de la ", ". ", "on the ", "est ", "\n", "", "export ", "- ", "  ", "with ")
    name = pick("name", "token", "secret", "password", "api_key", "auth_token", "access_key", "apikey", "PRIVATE_KEY", "client_secret", "DB_PASSWORD", "passwd", "aws_secret_access_key", "GITHUB_TOKEN", "API-KEY", "credentials", "SecretKey", "pwd", "TOKEN")
    sign = pick("sign", ' = "', "='", ": ", "=", "=", ' => "', ': "', '": "', "=", " := `", " = ")
    ending = F.when(sign.contains('"'), pick("c1", '" ', '",', '"\n', '"')).when(sign.contains("'"), pick("c2", "' ", "'\n", "',")).when(sign.contains("`"), F.lit("` ")).otherwise(pick("c3", " ", "\n", "\n", "&user=1 ", ""))
    assign = F.concat(prose("a0"), pick("open", "", "", "?", "?id=7&", '"', "https://h.io/a?"), name, sign)
    short = F.concat(word("s1"), pick("s2", "", "_", "-", "!", "@"), hexes("s3", 2, 4), pick("s4", "", "!", "$", "#1", "?"))
    placeholder = pick("q", "your_token_goes_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "example-secret-value-123", "changeme_changeme_1", "0000000000000000", "${API_KEY}", "test_password_example1", "$SECRET_VALUE", "changeme", "example", "********", "redacted", "dummy-value-99", "your-api-key-here", "{{vault_token}}", "%s:%s:%s", "sample_token_12")
    plain = F.concat(word("w1"), pick("wj", "", "", "_", "-", "."), F.when(F.pmod(F.xxhash64(i, F.lit("w")), F.lit(2)) == 0, word("w2")).otherwise(""), pick("we", "", "", ".", "s", "ed"))
    code = F.concat(pick("k1", "os.environ", "get_", "config.", "self.", "request.", "settings.", "load_"), word("k2"), pick("k3", "", "_token", ".value", "_name"))
    uuid = F.concat_ws("-", hexes("u1", 8), hexes("u2", 4), hexes("u3", 4), hexes("u4", 4), hexes("u5", 12))
    harmless = lambda salt: pick(salt, "commit ", "sha1: ", "rev ", "checksum=", "digest: ", "build ", "integrity ", "etag: ", "sha256: ", "hash=", "md5 ", "revision=", "ETag: \"", "version: ")
    after = pick("z", " ", "\n", ".", ", ", " the ", "")
    forms = [
        (1, assign, case("ha", hexes("a", 32, 64)), ending),
        (1, assign, case("hb", hexes("b", 40)), ending),
        (1, assign, mixed("c", 20, 60), ending),
        (1, assign, typed("t", 8, 20), ending),
        (1, assign, short, ending),
        (1, F.concat(prose("d0"), pick("d1", "key ", "id = ", "", "use ", "aws_access_key_id=", "AccessKeyId: ")), F.concat(pick("d2", "AKIA", "ASIA"), F.upper(hexes("d", 16))), after),
        (1, F.concat(prose("e0"), pick("e1", "GH=", "clone ", "", "git ", "token=", "GITHUB_TOKEN: ")), F.concat(pick("e2", "ghp_", "gho_", "glpat-", "sk-", "npm_", "xoxb-"), F.regexp_replace(mixed("e", 30, 40), "[+]", "x")), after),
        (1, pick("f0", "Authorization: Bearer ", "authorization: bearer ", "Authorization: Basic ", "-H 'Authorization: Bearer "), mixed("f", 24, 64), pick("f1", "\n", " ", "'")),
        (0, F.concat(prose("g0"), harmless("g1")), case("hg", hexes("g", 32, 64)), after),
        (0, F.concat(prose("h0"), pick("h1", "id=", "uuid: ", "guid ", "request ", "request_id=", "")), uuid, after),
        (0, prose("n0"), F.lpad(F.pmod(F.xxhash64(i), F.lit(10**15)).cast("string"), 16, "4"), after),
        (0, prose("v0"), F.concat(word("v1"), word("v2"), word("v3"), pick("v4", "", "2", "10", ".")), after),
        (0, prose("x0"), F.concat(word("x1"), F.initcap(word("x2")), F.initcap(word("x3")), F.initcap(word("x4"))), pick("x5", "(", " ", ".")),
        (0, prose("p0"), F.concat(pick("p1", "src/", "/usr/lib/", "docs/", "www."), word("p2"), F.lit("/"), word("p3"), pick("p4", ".py", ".html", "-1.2.3", "/index.html")), after),
        (0, assign, placeholder, ending),
        (0, assign, plain, ending),
        (0, F.concat(prose("k0"), name, pick("k4", " = ", "=", ": ")), code, pick("k5", "(", "\n", "[", " ", "()")),
        (0, prose("m0"), F.concat(hexes("m", 6), F.lit("."), pick("m1", "78", "12"), F.lit("mail"), pick("m2", "1", "7"), F.lit(".example.com")), F.lit(" ")),
        (0, F.concat(prose("o0"), pick("o1", "color: ", "path=", "name: ", "url = ")), F.concat(pick("o2", "https://", "/var/", "//"), word("o3"), F.lit(".io/"), hexes("o", 6, 12)), after),
    ]
    # Secrets and other findings are half and half.
    secret = sum(y for y, *_ in forms)
    number = F.when(i % 2 == 0, F.pmod(F.xxhash64(i, F.lit("form")), F.lit(secret))).otherwise(secret + F.pmod(F.xxhash64(i, F.lit("form")), F.lit(len(forms) - secret)))
    path = pick("path", "src0", "src7", "app/main.py", "web/settings.yml", "tests/fixtures/keys.py", "docs/readme.md", "examples/demo.sh", "src13")
    # A form at a time: one expression of all of them would be too large to compile.
    each = [spark.range(rows).where(number == k).select(F.lit(float(y)).alias("label"), F.concat(b, v, a).alias("text"), v.alias("value"), path.alias("path")) for k, (y, b, v, a) in enumerate(forms)]
    return reduce(DataFrame.unionByName, each)


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """``candidate, before, after, path, label``: what ``candidates`` cuts out of labelled texts. A finding other than the text's secret isn't one."""
    found = candidates(Workspace(spark, "labelled").table(labelled_texts(spark, rows), "texts"))
    return found.select("candidate", "before", "after", "path", ((F.col("candidate") == F.col("value")) & (F.col("label") == 1)).cast("double").alias("label"))


@dataclass
class Scanner:
    """A fitted forest and the probability from which a finding is a secret."""

    forest: RandomForestClassificationModel
    threshold: float = 0.5

    def scan(self, texts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``start, candidate, score, is_secret`` and the columns ``keep`` for each candidate in ``texts(text, path, ...)``."""
        found = features(candidates(texts))
        scored = self.forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(found))
        score = F.element_at(vector_to_array("__probability"), 2)
        return scored.select(*keep, "start", "candidate", score.alias("score"), (score >= self.threshold).alias("is_secret"))


def train(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 42, threshold: float = 0.5) -> Scanner:
    """Fit on findings ``label, candidate, before, after, path``, at most ``TRAINING_ROWS`` of them, chosen by hash. The number of threads and partitions doesn't change the result: the rows are put in one order first."""
    ws = Workspace(findings.sparkSession, "secrets")
    # One partition of a bounded number of rows gives the forest's sampling a fixed order.
    order = [F.xxhash64("candidate", "before", "after", "path"), "candidate", "before", "after", "path", "label"]
    fixed = findings.orderBy(*order).limit(TRAINING_ROWS).orderBy("candidate", "before", "after", "path", "label").coalesce(1)
    rows = ws.table(VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(features(fixed)).select("label", vector_to_array("__features").alias("values")), "findings")
    forest = RandomForestClassifier(labelCol="label", featuresCol="__features", probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return Scanner(forest.fit(rows.select("label", array_to_vector("values").alias("__features"))), threshold)


def scan_documents(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id, start, candidate, score, is_secret`` for each candidate in ``docs(doc_id, text, source)``, whole texts; the source is the path.

    The forest is trained on ``labelled_findings`` unless a scanner is given. A secret without a name before it and below
    ``LEAST`` characters, or a named one below ``LEAST_ASSIGNED``, is no candidate. Null and empty texts have no
    candidates; a null source is an empty path. Repeated rows and null ids each keep their candidates.
    Other columns don't matter. An empty table gives no rows.
    """
    scanner = scanner or train(labelled_findings(docs.sparkSession))
    return scanner.scan(docs.select("doc_id", "text", F.col("source").alias("path")))
