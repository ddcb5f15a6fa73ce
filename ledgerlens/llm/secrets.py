"""Secret scanning with a random forest that removes false positives, in DataFrame functions only.

Candidates are runs of sixteen or more key characters with a digit among them, and runs of eight or
more that are assigned to a name such as `token` or `password`, in the words before or inside the same
word, as in `password="hunter2abc"`. Each candidate is described by its
length, its character transitions, the share of it that ordinary words cover, its path and the words
beside it. A forest trained from labelled findings tells secrets from serial numbers, digests, ids,
placeholders and long words.

The dictionary is the most frequent words of all texts, counted over the whole corpus. Null and empty
texts have no candidates; a null path has no path marks. A candidate that occurs twice in a text, or in
a repeated row, is two findings. An empty table gives no findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import as_row, field, unit_hash, unpack

RUN = r"[A-Za-z0-9+/_=-]{16,}"
SHORT_RUN = r"[A-Za-z0-9+/_=@#$%!.-]{8,}"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
# Names that announce a secret, names that announce something else, folders of tests and papers.
SECRET_NAMES = "token|secret|passw|pwd|api.?key|apikey|access.?key|private.?key|auth|credential|bearer"
OTHER_NAMES = "sha|md5|checksum|digest|hash|commit|uuid|guid|isbn|issn|serial|version|phone|card|order|invoice|example|sample|dummy|id\\b"
TEST_PATH = "test|spec|fixture|mock|example|sample|vendor|docs?\\b|readme|lock"
DICTIONARY_WORDS = 400
# Between a name and its value inside one word; brackets and quotes may be escaped.
SIGN = r"""[\\"'\])]*[=:]++>?[\\"'`(\[]*"""
BESIDE = 2
THRESHOLD = 0.5


def frequent_words(docs: DataFrame, limit: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three to twelve letters a to z over all texts; ties in letter order."""
    words = docs.select(F.explode(F.split(F.lower(field("text")), r"[^\p{L}]+")).alias("word"))
    counted = words.where(F.col("word").rlike("^[a-z]{3,12}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(limit).collect()]


def candidates(docs: DataFrame, text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: the row of `docs` as `row`, word_no (from 0), candidate, before, after, path."""
    split = F.split(field(text), r"[\x20\x09-\x0D]+")
    where = field(path).cast("string") if path else F.lit(None).cast("string")
    marked = F.regexp_like(field(text), F.lit(RUN)) | F.regexp_like(F.lower(field(text)), F.lit(SECRET_NAMES))
    rows = docs.where(marked).select(as_row(docs), split.alias("words"), where.alias("path"))
    # Only the words that hold a run are spread out; each takes its neighbours along.
    long_runs = lambda w: F.filter(F.regexp_extract_all(w, F.lit(f"({RUN})"), F.lit(1)), lambda r: r.rlike("[0-9]"))
    around = lambda i, n: F.array_join(F.slice("words", F.greatest(i + 1, F.lit(1)), n), " ")

    def described(w: Column, i: Column) -> Column:
        before = F.array_join(F.slice("words", F.greatest(i - BESIDE + 1, F.lit(1)), F.least(i, F.lit(BESIDE))), " ")
        assigned = F.lower(before).rlike(f"({SECRET_NAMES})\\S*\\s?[=:]\\s?$")
        short_runs = F.when(assigned, F.regexp_extract_all(w, F.lit(f"({SHORT_RUN})"), F.lit(1))).otherwise(F.array())
        found = long_runs(w)
        runs = F.when(F.size(found) > 0, found).otherwise(short_runs)
        value = lambda start: F.regexp_extract_all(w, F.lit(f"(?i){start}{SIGN}({SHORT_RUN})"), F.lit(1))
        named = r"(?:" + SECRET_NAMES + r")[A-Za-z0-9_.-]*"
        inside = F.when(~w.rlike("[=:]"), F.array()).when(F.lower(before).rlike(f"({SECRET_NAMES})[^\\s=:]*$"), value(f"(?:^|{named})")) \
            .otherwise(value(named))
        # A value ends where its run ends; it is in a run already if that is the value, or ends in = and the value.
        new = F.filter(inside, lambda v: ~F.exists(runs, lambda r: (r == v) | F.endswith(r, F.concat(F.lit("="), v))))
        return F.struct(
            i.alias("word_no"), F.concat(runs, new).alias("runs"), w.alias("word"),
            before.alias("before"), around(i + 1, BESIDE).alias("after"))

    spread = rows.select("row", "path", F.explode(F.filter(F.transform("words", described), lambda s: F.size(s["runs"]) > 0)).alias("at"))
    return spread.select("row", "path", "at.word_no", "at.word", "at.before", "at.after", F.explode("at.runs").alias("candidate"))


def features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Adds the numbers the forest works with as `f_…` columns."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    kinds = F.translate(c, LETTERS + LETTERS.upper() + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    uncovered = F.regexp_replace(low, "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), "") if dictionary else low
    name = F.lower(F.concat_ws(" ", "before", F.expr("substring(word, 1, greatest(instr(word, candidate) - 1, 0))")))
    numbers = {
        "length": n,
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "digits": count(c, "[0-9]") / n,
        "upper": count(c, "[A-Z]") / n,
        "symbols": count(c, "[^A-Za-z0-9]") / n,
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(c.rlike("^[0-9]+$")),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "repeats": F.length(F.regexp_extract(low, r"((.)\2{3,})", 1)) / n,
        "covered": 1.0 - F.length(uncovered) / n,
        "dashed": count(c, "[-_/]") / n,
        "named_secret": flag(name.rlike(SECRET_NAMES)),
        "named_other": flag(name.rlike(OTHER_NAMES)) + flag(low.rlike("example|sample|dummy|changeme|xxxx")),
        "assigned": flag(name.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(F.col("word").rlike("[\"'][A-Za-z0-9+/_=-]{8,}[\"']")),
        "prose_after": count(F.col("after"), r"\p{L}{2,}"),
        "test_path": flag(F.lower("path").rlike(TEST_PATH)),
    }
    return found.select("*", *[F.coalesce(v, F.lit(0.0)).alias(f"f_{k}") for k, v in numbers.items()])


def labelled_findings(spark: SparkSession, n: int = 6000, dictionary: list[str] | None = None) -> DataFrame:
    """Labelled findings of common kinds, drawn by a hash of the row number: text, path, secret (0 or 1).

    Secrets: random keys in hex, letters and digits, base64, and known prefixes, mostly assigned to a
    telling name. Others: serial and card numbers, digests and ids named as such, placeholders, dotted or
    dashed names, long words with a number. Pass own findings with these columns to train for other kinds.
    """
    words = F.array(*[F.lit(w) for w in (dictionary or ["the", "and", "with", "from", "this", "value", "order", "page"])])
    i = F.col("id")

    def draw(label: str, size: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(label), i), F.lit(size)).cast("int")

    def choice(label: str, *options: str) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), draw(label, len(options)) + 1)

    def random(label: str, alphabet: str, size: Column) -> Column:
        pick = lambda j: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(F.lit(label), i, j), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), pick), "")

    def word(label: str) -> Column:
        return F.element_at(words, F.pmod(F.xxhash64(F.lit(label), i), F.size(words).cast("long")).cast("int") + 1)

    hexes, digits, letters = "0123456789abcdef", DIGITS, LETTERS + LETTERS.upper() + DIGITS
    secret_name = choice("sn", "token", "secret", "api_key", "password", "access_key", "auth", "private_key", "Bearer", "credentials", "TOKEN")
    other_name = choice("on", "sha1", "checksum", "commit", "uuid", "id", "serial", "order", "card", "md5", "invoice", "version")
    sign = choice("sg", " = ", ": ", "=", " ")
    quote = choice("q", '"', "'", "")
    key = F.element_at(F.array(
        random("h", hexes, F.lit(32) + 8 * draw("hl", 3)), F.upper(random("h", hexes, F.lit(40))),
        random("l", letters, F.lit(20) + draw("ll", 30)), random("b", letters + "+/", F.lit(40)),
        F.concat(F.lit("AKIA"), F.upper(random("a", LETTERS + DIGITS, F.lit(16)))),
        F.concat(choice("px", "ghp_", "sk-", "xoxb-", "glpat-"), random("g", letters, F.lit(36)))), draw("kind", 6) + 1)
    dashes = F.concat_ws("-", random("u1", hexes, F.lit(8)), random("u2", hexes, F.lit(4)), random("u3", hexes, F.lit(4)), random("u4", hexes, F.lit(12)))
    prose = lambda label: F.concat_ws(" ", word(label + "1"), word(label + "2"))
    as_secret = F.concat(prose("p"), F.lit(" "), F.when(draw("bare", 8) == 0, "").otherwise(F.concat(secret_name, sign)), quote, key, quote, F.lit(" "), prose("a"))
    as_other = F.element_at(F.array(
        F.concat(prose("p"), F.lit(" "), random("d", digits, F.lit(16) + draw("dl", 4)), F.lit(" "), prose("a")),
        F.concat(other_name, sign, quote, F.when(draw("od", 2) == 0, random("h", hexes, F.lit(32) + 8 * draw("hl", 3))).otherwise(dashes), quote, F.lit(" "), prose("a")),
        F.concat(secret_name, sign, quote, choice("ph", "xxxxxxxxxxxxxxxx0000", "your-token-here-123", "EXAMPLE0EXAMPLE0EXAMPLE", "changeme12345changeme", "<insert-key-00000000>"), quote, F.lit(" "), prose("a")),
        F.concat(prose("p"), F.lit(" "), word("w1"), word("w2"), word("w3"), word("w4"), word("w5"), random("d", digits, F.lit(2)), F.lit(" "), prose("a")),
        F.concat(prose("p"), F.lit(" /"), word("w1"), F.lit("/"), word("w2"), F.lit("/"), word("w3"), F.lit("-"), word("w4"), F.lit("-"), random("d", digits, F.lit(4)), F.lit(" "), prose("a")),
        F.concat(prose("p"), F.lit(" +"), random("d", digits, F.lit(17)), F.lit(" "), prose("a"))), draw("okind", 6) + 1)
    secret = draw("label", 2)
    path = F.when(secret == 1, choice("pa", "src/app.py", "config/prod.env", "deploy.sh", "src7", "notes.md", "tests/test_login.py")) \
        .otherwise(choice("pb", "package-lock.json", "docs/readme.md", "tests/fixture.json", "src7", "data/orders.csv", "src/app.py"))
    return spark.range(n).select(
        F.when(secret == 1, as_secret).otherwise(as_other).alias("text"), path.alias("path"), secret.alias("secret"))


def train_forest(findings: DataFrame, dictionary: list[str], trees: int = 40, depth: int = 8, seed: int = 17) -> RandomForestClassificationModel:
    """A forest from labelled findings (text, path, secret); their number is the caller's bound."""
    described = features(candidates(findings, "text", "path"), dictionary)
    names = [c for c in described.columns if c.startswith("f_")]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(
        described.select(*names, F.col("row.secret").cast("double").alias("label")))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, dictionary: list[str], text: str = "text",
         path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """The candidates of all rows: the columns of `docs` with word_no, candidate, score, is_secret (replaced if there)."""
    described = features(candidates(docs, text, path), dictionary)
    names = [c for c in described.columns if c.startswith("f_")]
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(described)) \
        .withColumn("score", vector_to_array("probability")[1])
    return unpack(scored, docs.columns, {
        "word_no": F.col("word_no"), "candidate": F.col("candidate"), "score": F.col("score"),
        "is_secret": F.col("score") >= threshold})


def held_out_accuracy(findings: DataFrame, dictionary: list[str], **options) -> float:
    """Share of right answers on a hashed third of the findings, by a forest trained on the rest."""
    part = unit_hash(F.lit("fold"), F.col("text"), F.col("path"))
    model = train_forest(findings.where(part >= 1 / 3), dictionary, **options)
    tested = scan(findings.where(part < 1 / 3), model, dictionary, "text", "path")
    return tested.agg(F.avg((F.col("is_secret").cast("int") == F.col("secret")).cast("double"))).first()[0]
