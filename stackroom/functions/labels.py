"""Deterministic classification: column expressions over evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackroom.functions.paths import basename, extension, filename_tokens

# Fixed values of the rule classifier.
DEPARTMENTS = ("art", "bio", "bus", "chm", "com", "csc", "eco", "eng", "fre", "his", "mat", "phy", "psy", "soc", "spa")
CODE_EXTENSIONS = ("c", "cc", "cpp", "cs", "go", "h", "hpp", "java", "js", "jsx", "kt", "m", "mm", "php", "py", "rb", "rs", "sh", "swift", "ts", "tsx")
MANIFEST_NAMES = ("cargo.toml", "dockerfile", "go.mod", "makefile", "package.json", "package.swift", "pom.xml", "pyproject.toml", "requirements.txt")
KIND_LABELS = {
    "image": ("Image", "kind:image"),
    "audio": ("Audio", "kind:audio"),
    "video": ("Video", "kind:video"),
    "pdf": ("Documents/PDF", "kind:pdf"),
    "text": ("Documents/Text", "kind:text"),
    "office": ("Documents/Office", "kind:office"),
    "archive": ("Archives", "kind:archive"),
    "diskImage": ("DiskImages", "kind:diskimage"),
    "application": ("Applications", "kind:app"),
    "package": ("Packages", "kind:package"),
    "symlink": ("Links", "kind:symlink"),
    "other": ("Review", "kind:unknown"),
}
VISION_CATEGORIES = (
    ("Image/Animals", ("cat", "dog", "bird", "horse", "elephant", "bear", "animal")),
    ("Image/Vehicles", ("car", "truck", "bus", "bicycle", "airplane", "boat", "vehicle")),
    ("Image/Scenery", ("beach", "mountain", "forest", "desert", "sky", "sunset", "landscape")),
    ("Image/Food", ("food", "pizza", "cake", "fruit", "vegetable", "meal")),
    ("Screenshots", ("screenshot", "screen")),
    ("Image/Documents", ("text", "document", "paper")),
)
MAX_CATEGORIES, MAX_REASONS, MAX_DESCRIPTION = 12, 16, 2000
# Words of course sites and of assignments.
LMS_NAMES = ("blackboard", "moodle", "instructure")
LMS_SHARED_NAME = "canvas"
LMS_CONTEXT = ("course", "module", "assignment", "instructure")
ASSIGNMENT_WORDS = ("worksheet", "assignment", "homework")
# Fixed values of the screenshot assessment.
SCREEN_RATIOS = (1.333, 1.5, 1.6, 1.667, 1.778, 1.8, 2.0, 2.167)
UI_WORDS = ("settings", "search", "share", "menu", "home", "back", "notifications", "browser", "tab", "http", "www")
SCREENSHOT_NAMES = ("screenshot", "screen shot", "screen-shot")
DISPLAY_WORDS = ("screen", "display", "iphone", "ipad")
SCREEN_LABELS = ("screen", "computer", "monitor")
MAP_LABELS = ("map", "navigation")
SCREENSHOT_REASONS = {
    "name": "filename:screenshot",
    "ratio": "dimensions:screen-ratio",
    "display": "metadata:display",
    "words": "content:ui-text",
    "text": "content:ocr",
    "label": "vision:screen-like",
    "fallback": "fallback:reference",
    "uncertain": "uncertain:review",
    "none": "insufficient-screenshot-evidence",
}
SUBTYPES = (
    ("lms", ("blackboard", "canvas", "moodle", "course content", "discussion board")),
    ("code", ("public static void", "import ", "class ", "traceback", "exception", "github", "vscode", "terminal")),
    ("school", ("quiz", "chapter", "homework", "worksheet", "precalculus", "java programming", "wake tech")),
    ("receipt", ("subtotal", "total", "order #", "order number", "receipt", "tax", "shipping", "tracking")),
    ("error", ("error", "failed", "warning", "crash", "cannot", "permission denied", "stack trace")),
    ("conversation", ("message", "sent", "delivered", "typing", "reply", "direct message")),
    ("social", ("followers", "following", "repost", "retweet", "likes", "comments", "share")),
    ("map", ("directions", "miles", "route", "arrive", "maps", "navigation")),
    ("meme", ("meme", "when you", "top text", "bottom text")),
)
# Fixed values of the junk scorer: concepts that protect an image.
PROTECTED_TERMS = (
    "person", "face", "portrait", "people", "child", "dog", "cat", "animal", "bird", "food", "meal", "car", "vehicle", "landscape", "beach",
    "mountain", "flower", "document", "paper", "book", "map", "diagram", "chart", "receipt", "screen", "computer", "laptop", "phone", "building", "room", "furniture",
)
MUSIC_AND_MEDIA = {
    "audio": ("mp3", "m4a", "wav", "aac", "flac", "ogg", "opus", "aiff", "caf"),
    "video": ("mp4", "mov", "m4v", "avi", "mkv", "webm"),
}
MUSIC_WORDS = ("music", "song", "album", "soundtrack")
SPEECH_REASONS = {
    "container": "probe:non-media-container",
    "empty": "probe:empty",
    "short": "probe:too-short",
    "long": "probe:too-long",
    "music": "probe:music-tag",
    "media": "probe:av-duration",
    "music-unknown": "probe:music-tag-no-duration",
    "size": "probe:container-gate",
    "unknown": "probe:unknown-container",
}

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def holds(text: Column, words) -> Column:
    return _any(F.contains(text, F.lit(w)) for w in words)


def courses(text: Column) -> Column:
    """Sorted distinct course codes (``DEPT-123``) of lower-case text."""
    pattern = rf"(?<![a-z0-9])((?:{'|'.join(DEPARTMENTS)})[ _-]?\d{{3,4}})(?![a-z0-9])"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda c: F.upper(F.concat(F.substring(c, 1, 3), F.lit("-"), F.regexp_extract(c, r"(\d+)$", 1))))))


def code_project(path: Column) -> Column:
    return F.lower(basename(path)).isin(*MANIFEST_NAMES) | F.lower(extension(path)).isin(*CODE_EXTENSIONS)


def lms_context(text: Column) -> Column:
    return holds(text, LMS_NAMES) | (F.contains(text, F.lit(LMS_SHARED_NAME)) & holds(text, LMS_CONTEXT))


def assignment_word(text: Column) -> Column:
    return holds(text, ASSIGNMENT_WORDS)


def vision_category(label: Column) -> Column:
    """The curated bucket of an image label; the first group that matches wins."""
    low = F.lower(label)
    return reduce(lambda out, c: out.when(holds(low, c[1]), c[0]), VISION_CATEGORIES, F.when(F.lit(False), ""))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "confident").when(confidence >= 0.45, "ambiguous").otherwise("unknown")


def classify(path: Column, kind: Column, text: Column, *, size_class: Column | None = None, placeholder: Column | None = None, vision: Column | None = None, screenshot: Column | None = None) -> Column:
    """Struct ``(categories, confidence, reasons)``.

    ``vision`` is an array of (label, confidence); ``screenshot`` a struct as :func:`assess_screenshot`
    makes it. Generic school words count only outside source code, and a name that says
    screenshot only for images.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    code = code_project(path)
    in_text = F.when(text.isNotNull(), courses(low)).otherwise(_none())
    in_name = courses(F.lower(basename(path)))
    prefix = lambda arr, p: F.transform(arr, lambda c: F.concat(F.lit(p), c))
    if_ = lambda test, value: F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(value))).otherwise(_none())
    label = reduce(lambda out, k: out.when(kind == k[0], k[1][0]), KIND_LABELS.items(), F.when(F.lit(False), "")).otherwise("Review")
    why = reduce(lambda out, k: out.when(kind == k[0], k[1][1]), KIND_LABELS.items(), F.when(F.lit(False), "")).otherwise("kind:unknown")
    shot_name = (kind == "image") & F.array_contains(filename_tokens(path), "screenshot")
    cats = [F.array(label)]
    reasons = [F.array(why)]
    if placeholder is not None:
        cats.append(if_(placeholder, "Review/CloudPlaceholder"))
        reasons.append(if_(placeholder, "cloud-placeholder"))
    if size_class is not None:
        reasons.append(if_(size_class == "huge", "size:huge"))
    lms, work = ~code & text.isNotNull() & lms_context(low), ~code & text.isNotNull() & assignment_word(low)
    cats += [prefix(in_text, "School/"), if_(lms, "School"), if_(work, "Assignment"), prefix(in_name, "School/"), if_(code, "Projects/Code")]
    reasons += [prefix(in_text, "text:"), if_(lms, "text:lms-context"), if_(work, "text:assignment-word"), prefix(in_name, "filename:"), if_(code, "project:code")]
    conf = F.lit(0.55) + F.when(F.size(in_text) > 0, 0.2).otherwise(0.0) + F.size(in_name) * 0.1 + F.when(code, 0.15).otherwise(0.0)
    if vision is not None:
        top = F.filter(F.slice(F.coalesce(vision, F.array().cast("array<struct<label:string,confidence:double>>")), 1, 6), lambda v: v["confidence"] >= 0.15)
        first = lambda v: F.substring(F.trim(F.substring_index(v["label"], ",", 1)), 1, 32)
        named = F.filter(top, lambda v: first(v) != "")
        cats.append(F.array_compact(F.transform(named, lambda v: vision_category(first(v)))))
        reasons.append(F.transform(named, lambda v: F.concat(F.lit("vision:"), F.replace(F.lower(first(v)), F.lit(" "), F.lit("-")))))
        conf = conf + F.size(F.filter(named, lambda v: vision_category(first(v)).isNotNull() & (v["confidence"] >= 0.5))) * 0.05
    cats.append(if_(shot_name, "Screenshot"))
    reasons.append(if_(shot_name, "filename:screenshot"))
    conf = conf + F.when(F.coalesce(shot_name, F.lit(False)), 0.1).otherwise(0.0)
    if screenshot is not None:
        is_shot = F.coalesce(screenshot["is_screenshot"], F.lit(False))
        cats += [if_(is_shot, "Screenshots"), F.when(is_shot & (screenshot["subtype"] != "unknown"), F.array(F.concat(F.lit("Screenshots/"), screenshot["subtype"]))).otherwise(_none()), if_(is_shot & (screenshot["confidence"] < 0.8), "Review")]
        reasons.append(F.when(is_shot, prefix(screenshot["reasons"], "screenshot:")).otherwise(_none()))
        conf = F.when(is_shot, F.greatest(conf, screenshot["confidence"])).otherwise(conf)
    all_cats = F.array_distinct(F.concat(*cats))
    capped = F.when(F.size(all_cats) > MAX_CATEGORIES, F.array(F.lit("categories-capped"))).otherwise(_none())
    return F.struct(F.slice(all_cats, 1, MAX_CATEGORIES).alias("categories"), F.least(conf, F.lit(0.99)).alias("confidence"), F.slice(F.concat(*reasons, capped), 1, MAX_REASONS).alias("reasons"))


def contract_ok(file_id: Column, categories: Column, description: Column, reasons: Column, confidence: Column) -> Column:
    """Whether a classification fits the contract: identifiers, labels, lengths and ranges."""
    label = lambda c: F.trim(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9 /._-]{0,63}$") & ~F.contains(c, F.lit(".."))
    tests = [file_id.rlike(r"^file_[\p{L}\p{N}_]*$"), F.length(file_id) <= 32, F.size(categories) <= MAX_CATEGORIES, F.forall(categories, label), F.length(description) <= MAX_DESCRIPTION, F.size(reasons) <= MAX_REASONS, F.forall(reasons, lambda r: F.length(r) <= 64), (confidence >= 0) & (confidence <= 1)]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def screenshot_subtype(text: Column, labels: Column) -> Column:
    out = reduce(lambda o, r: o.when(holds(text, r[1]), r[0]), SUBTYPES, F.when(F.lit(False), ""))
    return out.when(F.exists(labels, lambda x: holds(x, MAP_LABELS)), "map").otherwise("reference")


def assess_screenshot(filename: Column, width: Column, height: Column, properties: Column, ocr: Column, labels: Column) -> Column:
    """Struct ``(is_screenshot, subtype, confidence, reasons)`` from additive evidence."""
    why = SCREENSHOT_REASONS
    name, text = F.lower(filename), F.lower(F.coalesce(ocr, F.lit("")))
    low = F.transform(F.coalesce(labels, _none()), F.lower)
    props = F.coalesce(properties, _none())
    shorter, longer = F.least(width, height), F.greatest(width, height)
    ratio = F.when(shorter > 0, longer / shorter).otherwise(0.0)
    hits = reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in UI_WORDS))
    evidence = [
        (holds(name, SCREENSHOT_NAMES), F.lit(0.20), why["name"]),
        (width.isNotNull() & height.isNotNull() & _any(F.abs(ratio - r) < 0.035 for r in SCREEN_RATIOS) & (shorter >= 500), F.lit(0.35), why["ratio"]),
        (width.isNotNull() & F.exists(props, lambda p: holds(p, DISPLAY_WORDS)), F.lit(0.25), why["display"]),
        (hits > 0, F.least(F.lit(0.30), 0.10 + hits * 0.04), why["words"]),
        (F.regexp_replace(text, r"\s", "") != "", F.lit(0.10), why["text"]),
        (F.exists(low, lambda x: holds(x, SCREEN_LABELS)), F.lit(0.20), why["label"]),
    ]
    score = reduce(lambda a, b: a + b, (F.when(F.coalesce(t, F.lit(False)), w).otherwise(0.0) for t, w, _ in evidence))
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for t, _, r in evidence)))
    subtype = screenshot_subtype(text, low)
    shot = F.round(score, 6) >= 0.40
    conf = F.least(F.lit(0.99), 0.35 + score * 0.60 + F.when(subtype == "reference", 0.0).otherwise(0.15))
    extra = F.array_compact(F.array(F.when(subtype == "reference", F.lit(why["fallback"])), F.when(conf < 0.80, F.lit(why["uncertain"]))))
    return F.struct(
        shot.alias("is_screenshot"),
        F.when(shot, subtype).otherwise("unknown").alias("subtype"),
        F.when(shot, conf).otherwise(score).alias("confidence"),
        F.when(shot, F.concat(reasons, extra)).when(F.size(reasons) == 0, F.array(F.lit(why["none"]))).otherwise(reasons).alias("reasons"),
    )


def image_information(pixels: Column) -> Column:
    """Struct ``(range, variance, bins)`` of a grayscale thumbnail's values."""
    n = F.size(pixels)
    total = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x * x)
    mean = total / n
    return F.when(n > 0, F.struct((F.array_max(pixels) - F.array_min(pixels)).cast("int").alias("range"), F.greatest(F.lit(0.0), squares / n - mean * mean).alias("variance"), F.size(F.array_distinct(F.transform(pixels, lambda x: F.floor(x / 16)))).alias("bins")))


def assess_junk(width: Column, height: Column, size_bytes: Column, pixels: Column, ocr: Column, vision: Column, is_screenshot: Column) -> Column:
    """Struct ``(is_junk, score)``: useful text or a protected concept is a veto, the rest adds up."""
    letters = F.length(F.regexp_replace(F.coalesce(ocr, F.lit("")), r"[^\p{L}\p{N}]", ""))
    protected = F.exists(F.coalesce(vision, F.array().cast("array<struct<label:string,confidence:double>>")), lambda v: (v["confidence"] >= 0.30) & holds(F.lower(v["label"]), PROTECTED_TERMS))
    longer, shorter = F.greatest(width, height), F.least(width, height)
    area, aspect = width.cast("long") * height, longer / F.greatest(shorter, F.lit(1))
    info = image_information(pixels)
    disposable = (longer <= 128) | (area <= 16_384) | (aspect >= 10)
    blank = (info["range"] <= 8) | (info["variance"] <= 4)
    poor = (info["bins"] <= 3) | (info["variance"] <= 18)
    on = lambda t, w: F.when(F.coalesce(t, F.lit(False)), w).otherwise(0.0)
    score = on(longer <= 256, 0.35) + on(area <= 65_536, 0.25) + on(size_bytes <= 12 * 1024, 0.10) + on(aspect >= 10, 0.20)
    score = score + F.when(blank, F.when(disposable, 0.65).otherwise(0.10)).when(poor, F.when(disposable, 0.20).otherwise(0.05)).otherwise(0.0)
    score = score - on(is_screenshot & ~(F.coalesce(blank, F.lit(False)) & (longer <= 512)), 0.15)
    readable = (width > 0) & (height > 0) & (size_bytes > 0)
    final = F.when(~F.coalesce(readable, F.lit(False)) | (letters >= 24) | protected, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
    return F.struct((final >= 0.85).alias("is_junk"), final.alias("score"))


def route_models(kind: Column, confidence: Column, native_ocr: Column, document_like: Column, profile: str, available: list[str]) -> Column:
    """Specialist models in order, those that are available."""
    image = kind == "image"
    unsure = image & (confidence < 0.55)
    steps = [("siglip2", image), ("dinov3", image)]
    if profile != "fast":
        steps += [("paddle-ocr", image & document_like & ~native_ocr), ("minicpm", unsure)]
    if profile == "quality":
        steps.append(("lfm", unsure))
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(m)) for m, t in steps if m in available) or [F.lit(None).cast("string")]))


def speech_gate(extension_: Column, magic: Column, tag: Column, duration: Column, size: Column, music: tuple[str, ...] = MUSIC_WORDS) -> Column:
    """Struct ``(transcribe, reason)`` of the media gate; ``magic`` says whether the bytes look like audio."""
    why = SPEECH_REASONS
    ext = F.lower(F.coalesce(extension_, F.lit("")))
    media = ext.isin(*MUSIC_AND_MEDIA["audio"], *MUSIC_AND_MEDIA["video"]) | F.coalesce(magic, F.lit(False))
    tagged = holds(F.lower(F.coalesce(tag, F.lit(""))), music)
    known = F.coalesce(duration > 0, F.lit(False))
    reason = (
        F.when(~media, why["container"])
        .when(~known & (size == 0), why["empty"])
        .when(known & (duration < 1), why["short"])
        .when(known & (duration > 7200), why["long"])
        .when(known & tagged, why["music"])
        .when(known, why["media"])
        .when(tagged, why["music-unknown"])
        .when(size >= 1024, why["size"])
        .otherwise(why["unknown"])
    )
    return F.struct(reason.isin(why["media"], why["size"]).alias("transcribe"), reason.alias("reason"))


def looks_like_audio(content: Column) -> Column:
    """Magic numbers of common audio containers."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(head.rlike("^FF[EF]") | head.rlike("^(664C6143|4F676753|52494646|494433)") | head.rlike("^.{8}66747970"), F.lit(False)) & (F.octet_length(content) >= 4)
