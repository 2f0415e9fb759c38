"""Languages and file kinds by extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python",
    "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "hxx": "cpp",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "cs": "c_sharp",
    "vue": "vue", "svelte": "svelte",
    "rb": "ruby", "php": "php", "lua": "lua", "dart": "dart", "elixir": "elixir", "ex": "elixir", "exs": "elixir", "swift": "swift",
    "sh": "bash", "bash": "bash", "zsh": "bash",
    "sql": "sql", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "scss": "scss", "sass": "sass",
}
# Extensions of binary files.
BINARY = "png jpg jpeg gif bmp ico svg webp mp3 mp4 wav avi mov mkv zip tar gz bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx exe dll so dylib bin o a wasm class jar war ttf otf woff woff2 eot db sqlite sqlite3".split()
# Folders that are never scanned.
SKIPPED_FOLDERS = "node_modules .git dist build __pycache__ .venv venv .next .nuxt coverage .nyc_output .index".split()
# Patterns that are ignored unless a project's own list takes them back.
IGNORED = "node_modules .git dist build __pycache__ .venv venv .env .env.local .next .nuxt coverage .nyc_output *.lock package-lock.json yarn.lock pnpm-lock.yaml".split()
MAX_FILE_BYTES = 1_048_576


def plain(extension: Column) -> Column:
    return F.lower(F.regexp_replace(extension, r"^\.", ""))


def detect_language(extension: Column) -> Column:
    """The language of an extension, whatever its case, with or without a dot; null if unknown."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    return F.try_element_at(names, plain(extension))


def is_binary(extension: Column) -> Column:
    return F.coalesce(plain(extension).isin(*BINARY), F.lit(False))


def supported(spark: SparkSession) -> DataFrame:
    """(extension, language) of all supported extensions."""
    return spark.createDataFrame(list(LANGUAGES.items()), "extension string, language string")
