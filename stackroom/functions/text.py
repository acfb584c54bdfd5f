"""Text expressions: tokens, phrases, ranking, snippets, chunks, compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackroom.functions.paths import basename, extension

K1, B = 1.2, 0.75


def tokens(text: Column, fold_diacritics: bool = False) -> Column:
    """Lower-case runs of letters and digits."""
    low = F.lower(text)
    if fold_diacritics:
        low = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(phrase: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", phrase.lower()) if t]


def contains_phrase(toks: Column, phrase: str) -> Column:
    """Whether the tokens hold the phrase's tokens in a row; never for a blank phrase."""
    words = query_tokens(phrase)
    if not words:
        return F.lit(False)
    padded = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return F.contains(padded, F.lit(" " + " ".join(words) + " "))


def phrase_positions(toks: Column, phrase: str) -> Column:
    """Zero-based token positions where the phrase starts; overlapping ones count."""
    words = query_tokens(phrase)
    k = len(words)
    last = F.size(toks) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    want = F.array(*(F.lit(w) for w in words))
    return F.filter(starts, lambda i: F.slice(toks, i + 1, F.lit(k)) == want)


def idf(n: Column, df: Column) -> Column:
    """Never negative: frequent phrases rank low, not backwards."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, n: Column, df: Column, avg_length: Column) -> Column:
    """Okapi BM25, negated so that ascending order is best first."""
    return -(idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length)))


def snippet(toks: Column, position: Column, words: int, window: int = 12) -> Column:
    """A window of tokens with the match in brackets and ellipses where text is cut."""
    start = F.greatest(F.lit(0), F.least(position - F.lit((window - words) // 2), F.size(toks) - window))
    cut = F.slice(toks, start + 1, F.lit(window))
    at = position - start
    marked = F.transform(cut, lambda t, i: F.concat(F.when(i == at, "[").otherwise(""), t, F.when(i == at + (words - 1), "]").otherwise("")))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(marked, " "), F.when(start + window < F.size(toks), "…").otherwise(""))


def flatten_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda, expressions are not shared."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """Overlapping pieces of trimmed text, trimmed themselves; the first to reach the end is the last."""
    step = size - overlap

    def cut(body):
        n = F.length(body)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: trimmed(body.substr(i * step + 1, F.lit(size))))

    return F.filter(let(trimmed(text), cut), lambda p: p != "")


# Fixed values of the compaction router.
SOURCE_EXTENSIONS = (
    "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "m", "mm", "swift", "rs", "go", "java", "kt", "kts", "scala", "cs", "fs", "fsx",
    "py", "pyx", "rb", "php", "js", "jsx", "ts", "tsx", "mjs", "cjs", "sh", "bash", "zsh", "fish", "ps1", "lua", "r", "jl", "dart",
    "ex", "exs", "erl", "hrl", "clj", "cljs", "cljc", "hs", "lhs", "ml", "mli", "sol", "proto", "graphql", "gql", "sql",
    "html", "htm", "css", "scss", "sass", "less", "vue", "svelte", "astro", "cmake", "gn", "gni", "bzl",
)
SOURCE_NAMES = ("makefile", "dockerfile", "podfile", "gemfile", "rakefile", "package.swift", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "cmakelists.txt", "meson.build", "build.ninja")
SKIP_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "podfile.lock", "composer.lock", "gemfile.lock")
DECLARATIONS = ("class ", "struct ", "enum ", "protocol ", "extension ", "func ", "interface ", "record ", "def ", "async def ", "fn ", "trait ", "impl ", "function ", "export ", "import ", "package ", "module ")
PRIMARY, HEAD, TAIL, DECLARATION_LINE, DECLARATION_BLOCK, PROSE_CHUNKS = 4000, 2400, 800, 220, 1000, 6


def compaction_strategy(path: Column, text: Column) -> Column:
    """``skip``, ``source`` or ``prose``."""
    name, ext = F.lower(basename(path)), F.lower(extension(path))
    blank = F.coalesce(trimmed(text), F.lit("")) == ""
    skip = blank | name.isin(*SKIP_NAMES) | (ext == "map") | name.endswith(".min.js") | name.endswith(".min.css")
    return F.when(skip, "skip").when(ext.isin(*SOURCE_EXTENSIONS) | name.isin(*SOURCE_NAMES), "source").otherwise("prose")


def source_capsule(path: Column, text: Column) -> Column:
    """File name, head, declarations and tail of source text, at most 4000 characters."""
    body = trimmed(text)
    starts = lambda line: reduce(lambda a, b: a | b, (F.startswith(F.lower(line), F.lit(p)) for p in DECLARATIONS))
    lines = F.transform(F.filter(F.transform(F.split(body, "\n"), F.trim), starts), lambda x: F.substring(x, 1, DECLARATION_LINE))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def add(s, line):
        fits = s["open"] & (s["used"] + F.length(line) <= DECLARATION_BLOCK)
        return F.struct(F.when(fits, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"), (s["used"] + F.when(fits, F.length(line) + 1).otherwise(0)).alias("used"), fits.alias("open"))

    declared = F.array_join(F.aggregate(lines, empty, add, lambda s: s["out"]), "\n")
    tail = F.substring(body, -TAIL, TAIL)
    tail = F.when(F.length(body) < TAIL, body).otherwise(tail)
    whole = F.concat(F.lit("file: "), basename(path), F.lit("\nhead:\n"), F.substring(body, 1, HEAD), F.lit("\ndeclarations:\n"), declared, F.lit("\ntail:\n"), tail)
    return F.substring(whole, 1, PRIMARY)


def compacted(path: Column, text: Column) -> Column:
    """Struct ``(strategy, primary, chunks)``."""
    strategy = compaction_strategy(path, text)
    body = trimmed(text)
    primary = F.when(strategy == "source", source_capsule(path, text)).when(strategy == "prose", F.substring(body, 1, PRIMARY))
    parts = F.when(strategy == "prose", F.slice(chunks(text), 1, PROSE_CHUNKS)).otherwise(F.array().cast("array<string>"))
    return F.struct(strategy.alias("strategy"), primary.alias("primary"), parts.alias("chunks"))


def needs_ocr(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)), F.lit(0)) < 50


def text_density(text: Column, size: Column) -> Column:
    return F.when(text.isNull() | (size <= 0), 0.0).otherwise(F.octet_length(text) / size)


def clock_seconds(stamp: Column) -> Column:
    """Seconds of ``HH:MM:SS,mmm``; null where it isn't one."""
    parts = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    num = [F.get(parts, i).try_cast("double") for i in range(3)]
    return F.when(F.size(parts) == 3, num[0] * 3600 + num[1] * 60 + num[2])


def model_json(text: Column, allowed: list[str], limit: int = 6) -> Column:
    """Categories and clamped confidence from the first ``{`` to the last ``}`` of a model's answer."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "categories array<string>, confidence double")
    kept = F.slice(F.filter(F.coalesce(parsed["categories"], F.array().cast("array<string>")), lambda c: c.isin(*allowed)), 1, limit)
    return F.struct(kept.alias("categories"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["confidence"], F.lit(0.0)))).alias("confidence"))


def encoded(value: Column) -> Column:
    """An array, map or struct as JSON text; null stays null."""
    return F.to_json(value)


def decoded(text: Column, kind: str) -> Column:
    """The array, map or struct of type ``kind`` that JSON text holds; null where it holds none."""
    return F.from_json(text, kind)
