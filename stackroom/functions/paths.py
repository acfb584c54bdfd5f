"""Path, name and size expressions. Paths are plain strings; comparisons are binary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, prefixes and file names that are never user content.
EXCLUDED_DIRECTORIES = (
    ".git", ".hg", ".svn", ".bzr", "node_modules", "Pods", "Carthage", ".swiftpm",
    "DerivedData", "build", ".build", "dist", "out", "obj", "target", "WebKitBuild", "buck-out", ".cxx", ".ccache", ".sccache",
    "bazel-bin", "bazel-out", "bazel-testlogs", "cmake-build-debug", "cmake-build-release", "cmake-build-relwithdebinfo", "cmake-build-minsizerel",
    ".gradle", ".m2", ".npm", ".yarn", ".pnpm-store", ".cargo", ".rustup", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".vite", ".mozbuild",
    ".cache", "Caches", "__pycache__", ".Trash",
)
EXCLUDED_PREFIXES = ("obj-", "cmake-build-", "bazel-")
TRANSIENT_NAMES = (".DS_Store", ".localized")
TRANSIENT_PREFIXES = ("._", "~$")
TRANSIENT_SUFFIXES = (".crdownload", ".download", ".part", ".partial")

# Kinds by extension.
PACKAGE_EXTENSIONS = ("photoslibrary", "bundle", "framework", "xcodeproj", "docset", "playground", "rtfd", "draftsBundle", "moverbundle")
KINDS = {
    "archive": ("zip", "tar", "gz", "tgz", "bz2", "tbz", "tbz2", "xz", "txz", "lzma", "z", "7z", "rar", "jar", "war", "ear", "cpio", "pax", "xar", "aar", "cab", "zst"),
    "diskImage": ("dmg", "iso", "img", "cdr", "udf", "sparseimage", "sparsebundle", "smi"),
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg", "jpe", "gif", "heic", "heif", "heics", "avif", "tiff", "tif", "bmp", "webp", "jp2", "jxl", "ico", "icns", "svg", "psd", "tga", "exr", "hdr", "dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2"),
    "video": ("mp4", "mov", "m4v", "avi", "mkv", "webm", "mpg", "mpeg", "m2v", "3gp", "3g2", "wmv", "m2ts", "mts", "vob", "ogv", "flv", "qt"),
    "audio": ("mp3", "mp2", "wav", "m4a", "m4b", "m4r", "aac", "flac", "ogg", "oga", "opus", "aiff", "aif", "aifc", "caf", "wma", "au", "amr", "mid", "midi"),
    "office": ("docx", "xlsx", "pptx", "xls", "xlsm", "xlsb", "xltx", "ppt", "pps", "ppsx", "pptm", "potx", "ods", "odp", "numbers", "key"),
    "text": ("txt", "text", "md", "markdown", "rst", "rtf", "html", "htm", "xhtml", "shtml", "json", "xml", "xsl", "yaml", "yml", "toml", "css", "csv", "tsv", "log", "tex", "vcf", "ics", "vtt", "srt", "diff", "patch", "c", "cc", "cpp", "cxx", "cs", "go", "h", "hh", "hpp", "java", "js", "mjs", "jsx", "kt", "m", "mm", "php", "pl", "pm", "py", "rb", "rs", "s", "asm", "f", "f90", "pas", "r", "lua", "scala", "sh", "bash", "zsh", "csh", "command", "swift", "ts", "tsx", "sql"),
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the last component; empty for dot files and names without one."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    """Name of the folder that holds the file; null at the top."""
    return F.get(F.filter(F.split(path, "/"), lambda p: p != ""), F.size(F.filter(F.split(path, "/"), lambda p: p != "")) - 2)


def strip_slash(root: str) -> str:
    return root[:-1] if len(root) > 1 and root.endswith("/") else root


def under(path: Column, root: str | Column) -> Column:
    """Whether a path is the root or below it. Wildcards in the root mean nothing."""
    if isinstance(root, str):
        root = strip_slash(root)
        if root == "/":
            return path.startswith("/")
        return (path == root) | path.startswith(root + "/")
    clean = F.when((F.length(root) > 1) & root.endswith("/"), F.regexp_replace(root, "/$", "")).otherwise(root)
    return (path == clean) | F.startswith(path, F.when(clean == "/", clean).otherwise(F.concat(clean, F.lit("/"))))


def excluded_directory(path: Column, names: tuple[str, ...] = EXCLUDED_DIRECTORIES) -> Column:
    lower = lambda c: reduce(lambda a, b: a | b, (F.lower(c).startswith(p) for p in EXCLUDED_PREFIXES))
    return F.exists(F.split(path, "/"), lambda c: c.isin(*names) | lower(c))


def transient(path: Column) -> Column:
    name = basename(path)
    tests = [name.isin(*TRANSIENT_NAMES), *(name.startswith(p) for p in TRANSIENT_PREFIXES), *(F.lower(name).endswith(s) for s in TRANSIENT_SUFFIXES)]
    return reduce(lambda a, b: a | b, tests)


def live_excluded(path: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [transient(path), excluded_directory(path), *(under(path, p) for p in prefixes)])


def kind(path: Column, is_symlink: Column | None = None) -> Column:
    """One of twelve kinds. Package extensions match by case, others do not."""
    name, ext = basename(path), F.lower(extension(path))
    out = F.when(F.endswith(name, F.lit(".app")), "application").when(reduce(lambda a, b: a | b, (name.endswith("." + e) for e in PACKAGE_EXTENSIONS)), "package")
    if is_symlink is not None:
        out = F.when(is_symlink, "symlink").when(F.endswith(name, F.lit(".app")), "application").when(reduce(lambda a, b: a | b, (name.endswith("." + e) for e in PACKAGE_EXTENSIONS)), "package")
    for k, extensions in KINDS.items():
        out = out.when(ext.isin(*extensions), k)
    return out.otherwise("other")


def size_class(size: Column) -> Column:
    return F.when(size < 1024, "tiny").when(size < 102_400, "small").when(size < 10_485_760, "medium").when(size < 1_073_741_824, "large").otherwise("huge")


def filename_tokens(path: Column) -> Column:
    """Sorted distinct lower-case words of the name, of two characters and one letter at least."""
    parts = F.transform(F.split(stem(path), r"[ _\-.\[\]()]"), F.lower)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: (F.length(p) > 1) & p.rlike(r"\p{L}"))))


def category_path(path: Column) -> Column:
    """Components trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""), "/")


def opaque_id(path: Column) -> Column:
    return F.concat(F.lit("file_"), F.substring(F.sha2(path, 256), 1, 12))


def cloud_placeholder(ubiquitous: Column, download_status: Column, logical: Column, allocated: Column) -> Column:
    return F.when(F.coalesce(ubiquitous, F.lit(False)), F.coalesce(download_status != "current", F.lit(False))).otherwise(F.coalesce((logical > 0) & (allocated == 0), F.lit(False)))
