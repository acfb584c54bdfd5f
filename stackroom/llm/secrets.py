"""Secret scans, JVM-side only: base patterns and character Markov models.

Base patterns find assignments, access keys and hex digests. For other long tokens, two
first-order character models, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a token is a secret when the mean log-likelihood ratio of its
transitions passes a threshold. Ordinary identifiers are gathered from all documents: every
word that occurs twice or more, weighted by the logarithm of its count, so that neither one
text with many copies nor the strings that are looked for, which rarely recur, lead the model.
The models reach the plan as one array of ratios, one entry for each pair of characters,
whatever the corpus holds.

A text is matched against a pattern only if a cheaper test lets it: a substring that every
match holds, or a long enough run of token characters, which one pass finds for all.

Positions are code points, ends exclusive. They come from splitting the text at the pattern:
pieces and matches alternate, so one pass over their lengths gives every start.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.session import cut

#: The base patterns, in the order in which their kinds are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Runs that cannot reach the least length are not worth listing; a run is matched whole either way.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"(?<![0-9a-f])[0-9a-f]{32,}+"

#: What a text must hold, lower-cased, for an assignment.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_LEAST = 20
#: A run is matched from its first character on, or not at all.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % TOKEN_LEAST
WORD = r"(?<![A-Za-z])[A-Za-z]{2,}+[0-9]{0,3}"
RATIO = 0.8
RANDOM_STRINGS = 2000
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _found(text: Column, pattern: str, kind: str, passes, may: Column | None = None, known: Column | None = None) -> Column:
    """Array of ``(start, kind, end)`` for the matches that pass; ``known`` are the matches if they are at hand."""
    nothing = F.array().cast("array<string>")
    matches = known if known is not None else F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing)
    pieces = F.split(text, pattern, -1)
    k = F.lit(KINDS.index(kind))
    none = F.array().cast(SPANS)

    def step(state, pair):
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        hit = F.array(F.struct(start.alias("start"), k.alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(passes(pair["match"]), F.concat(state["out"], hit)).otherwise(state["out"]).alias("out"))

    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), F.coalesce(m, F.lit("")).alias("match")))
    # The last piece has no match: an empty one, which never passes.
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(F.size(matches) > 0, walked).otherwise(none)


def _may_assign(lower: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(lower, F.lit(x)) for x in ASSIGN_HINTS))


def _joined(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def labelled_samples(docs: DataFrame, *, text_col: str = "text", random_strings: int = RANDOM_STRINGS, seed: int = 23) -> DataFrame:
    """Labelled samples ``(token, secret, weight)``.

    Secrets are ``random_strings`` times four strings drawn from a keyed hash in the usual
    notations (hex, base64, base64url, upper-case keys). Ordinary identifiers are the words of
    all documents outside base matches, and the seams of snake, kebab and camel case that their
    ends and beginnings make; what occurs once only weighs nothing and is left out.
    """
    spark = docs.sparkSession
    raw = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")), 512)
    b64 = F.base64(F.unhex(raw))
    random = spark.range(random_strings).select(F.explode(F.array(F.substring(raw, 1, 40), F.substring(b64, 1, 44), F.translate(F.substring(b64, 1, 44), "+/", "-_"), F.translate(F.substring(F.upper(b64), 1, 40), "+/=", ""))).alias("token"), F.lit(True).alias("secret"), F.lit(1).cast("long").alias("weight"))
    texts = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null").withColumn("lower", F.lower("t"))
    # Base matches that are long enough hold token characters in a row; others are no secrets.
    bare = F.when(_may_assign(F.col("lower")), F.regexp_replace("t", ASSIGN, " ")).otherwise(F.col("t"))
    bare = texts.select(bare.alias("t")).select(F.when(F.contains("t", F.lit("AKIA")), F.regexp_replace("t", ACCESS_LONG, " ")).otherwise(F.col("t")).alias("t"))
    words = bare.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("token"))
    counted = words.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("weight", F.floor(F.log2("n")).cast("long"))
    last, first, second = F.right("token", F.lit(1)), F.substring("token", 1, 1), F.substring("token", 2, 1)
    forms = F.array(F.col("token"), F.concat(last, F.lit("_"), first), F.concat(last, F.lit("-"), first), F.concat(last, F.upper(first), second))
    ordinary = counted.select(F.explode(forms).alias("token"), F.lit(False).alias("secret"), "weight")
    return random.unionByName(ordinary)


def fit(samples: DataFrame, *, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of every transition, indexed by ``(first + 1) * width + second + 1``; 0 stands for other characters.

    ``samples`` are ``(token, secret)``, with a ``weight`` or of equal ones.
    """
    width = len(ALPHABET) + 1
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    weight = F.col("weight") if "weight" in samples.columns else F.lit(1).cast("long")
    pairs = samples.where(F.length("token") >= 2).select("secret", weight.alias("weight"), F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: at(F.col("token").substr(i, F.lit(1))) * width + at(F.col("token").substr(i + 1, F.lit(1))))).alias("pair"))
    counts = {True: [0] * width * width, False: [0] * width * width}
    for r in pairs.groupBy("secret", "pair").agg(F.sum("weight").alias("n")).collect():
        counts[r["secret"]][r["pair"]] = r["n"]
    rows = {s: [sum(c[i * width : (i + 1) * width]) for i in range(width)] for s, c in counts.items()}
    prob = lambda s, i: (counts[s][i] + smoothing) / (rows[s][i // width] + smoothing * width)
    return [round(math.log(prob(True, i) / prob(False, i)), 4) for i in range(width * width)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions."""
    width = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    codes = F.transform(F.split(token, ""), lambda c: at(c))
    pairs = F.zip_with(codes, F.slice(codes, 2, 1_000_000_000), lambda a, b: a * width + b)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(table, i), F.lit(0.0)))
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def scan(docs: DataFrame, model: list[float] | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = RATIO) -> DataFrame:
    """Rows ``(doc_id, base, extra)``, one for each row of ``docs``: arrays of ``(start, kind, end)``.

    ``base`` holds the base patterns' spans in order, ``extra`` those the models add: tokens of
    20 characters or more (shorter ones have too few transitions to tell) whose mean ratio is
    ``threshold`` or more and that no base span overlaps. A null text is an empty one. Texts are
    searched whole, however long. Ids keep their type. Repeated rows get equal results; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = base.withColumn("lower", F.lower("text")).withColumn("tokens", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    found = found.withColumn("assign", _found(F.col("text"), ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"], _may_assign(F.col("lower"))))
    found = found.withColumn("access", _found(F.col("text"), ACCESS_LONG, "access", lambda m: F.length(m) >= LEAST["access"], F.contains("text", F.lit("AKIA"))))
    found = found.withColumn("hex", _found(F.col("text"), HEX_LONG, "hex", lambda m: F.length(m) >= LEAST["hex"], F.exists("tokens", lambda t: F.length(t) >= LEAST["hex"])))
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    if model is None:
        extra = F.array().cast(SPANS)
    else:
        spans = _found(F.col("text"), TOKEN, "markov", lambda m: (F.length(m) >= TOKEN_LEAST) & (ratio(m, model) >= threshold), known=F.col("tokens"))
        extra = F.filter(spans, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.withColumn("extra", extra).select("doc_id", "base", "extra")


def report(spans: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of :func:`scan`'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return spans.withColumn("all", F.array_sort(F.concat("base", "extra"))).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))


def train(docs: DataFrame, *, text_col: str = "text", **options) -> list[float]:
    """A model from the default labelled samples."""
    return fit(cut(labelled_samples(docs, text_col=text_col, **options), "samples"))
