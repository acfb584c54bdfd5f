"""The presentation taxonomy of smart groups: which category paths may show, under which title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackroom.functions.labels import DEPARTMENTS

# Titles, subtitles and priorities.
SPECS = {
    "Projects/Code": ("Code projects", "Projects", 106),
    "Assignment": ("Assignments", "School & work", 100),
    "Image/Junk": ("Likely image junk", "Review before deleting", 108),
    "Documents/PDF": ("PDFs", "Documents", 90),
    "Documents/Office": ("Office documents", "Documents", 90),
    "Image/Animals": ("Animals", "Images", 82),
    "Image/Vehicles": ("Vehicles", "Images", 82),
    "Image/Scenery": ("Scenery", "Images", 82),
    "Image/Food": ("Food", "Images", 82),
    "Image/Documents": ("Document photos", "Images", 82),
}
SCREENSHOT_SUBTYPES = ("code", "school", "lms", "receipt", "error", "conversation", "social", "map", "meme", "reference")
COMPOSITES = {
    "composite:installers-archives": (("Applications", "DiskImages", "Packages", "Archives"), "Installers & archives", "apps, disk images & archives", 96),
    "composite:media": (("Audio", "Video"), "Recordings & media", "audio & video", 92),
}
LANE_LIMITS = {"duplicates": 3, "screenshots": 4, "school": 4, "projects": 2, "semantic": 5, "downloads": 1, "media": 1, "junk": 1, "general": 4}


def humanize(value: Column) -> Column:
    """Words capitalised, three acronyms upper-cased."""
    words = F.filter(F.split(F.translate(value, "_-", "  "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin("lms", "pdf", "ui"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))), " ")


def canonical_course(value: Column) -> Column:
    return F.when(value.rlike(rf"^({'|'.join(d.upper() for d in DEPARTMENTS)})-[0-9]{{3,4}}$"), value)


def spec(path: Column) -> Column:
    """Struct ``(title, subtitle, priority)``, null for paths that may not show."""
    parts = F.split(path, "/")
    leaf = F.get(parts, 1)
    pair = F.size(parts) == 2
    make = lambda t, s, p: F.struct(t.alias("title"), F.lit(s).alias("subtitle"), F.lit(p).alias("priority"))
    out = F.when(pair & (parts[0] == "Screenshots") & leaf.isin(*SCREENSHOT_SUBTYPES), make(F.concat(humanize(leaf), F.lit(" screenshots")), "Screenshots", 112))
    out = out.when(pair & (parts[0] == "School") & canonical_course(leaf).isNotNull(), make(leaf, "School", 110))
    return reduce(lambda o, s: o.when(path == s[0], make(F.lit(s[1][0]), s[1][1], s[1][2])), SPECS.items(), out)


def lane(group_id: Column, kind: Column) -> Column:
    return (
        F.when(kind == "nearDuplicate", "duplicates")
        .when(kind == "semantic", "semantic")
        .when(group_id == "composite:installers-archives", "downloads")
        .when(group_id == "composite:media", "media")
        .when(group_id == "category:Image/Junk", "junk")
        .when(group_id.startswith("category:Screenshots/"), "screenshots")
        .when(group_id.startswith("category:School/"), "school")
        .when(group_id.startswith("category:Projects/"), "projects")
        .otherwise("general")
    )
