"""Record types, value domains and the language registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

SYMBOL = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("symbol_name", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("code_content", T.StringType(), False),
    ]
)
SYMBOL_COLUMNS = tuple(f.name for f in SYMBOL)
#: A symbol with its place in the extractor's output; of equal keys in a file the greatest ``seq`` counts.
EXTRACTED = T.StructType([*SYMBOL.fields, T.StructField("seq", T.IntegerType(), False)])
FILE = T.StructType([T.StructField("rel", T.StringType()), T.StructField("sha1", T.StringType()), T.StructField("mtime", T.DoubleType())])
HIT_COLUMNS = ("rank", "score", "dense_similarity", "lexical_score", *SYMBOL_COLUMNS)

KINDS = ("function", "class", "section")

# Languages with a grammar, their file extensions and the extra that installs the grammar (None: always there).
LANGUAGES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "python": ((".py", ".pyi"), None),
    "powershell": ((".ps1", ".psm1"), None),
    "csharp": ((".cs",), None),
    "javascript": ((".js", ".jsx", ".mjs", ".cjs"), "javascript"),
    "typescript": ((".ts", ".tsx"), "typescript"),
    "go": ((".go",), "go"),
    "rust": ((".rs",), "rust"),
    "bash": ((".sh", ".bash"), "bash"),
}
# Formats of definition files, and their extensions.
DEFINITIONS: dict[str, tuple[str, ...]] = {
    "yaml": (".yaml", ".yml"),
    "markdown": (".md", ".markdown"),
    "msbuild": (".csproj", ".props", ".targets"),
}
LANGUAGE_NAMES = (*LANGUAGES, *DEFINITIONS)
#: Name of the folder that holds an index inside its root.
INDEX_DIR = ".codelode_index"
IGNORE_FILE = ".codelodeignore"


def registry(spark: SparkSession) -> DataFrame:
    """(ext, language, extra, definition): a row for each extension; a dimension of some thirty rows."""
    rows = [(e, lang, extra, False) for lang, (exts, extra) in LANGUAGES.items() for e in exts]
    rows += [(e, lang, None, True) for lang, exts in DEFINITIONS.items() for e in exts]
    return spark.createDataFrame(rows, "ext string, language string, extra string, definition boolean")


def extensions(definitions: bool, installed: frozenset[str] | None = None) -> set[str]:
    """Extensions that can be indexed: of installed languages (None: all), and of definition files if asked for."""
    found = {e for lang, (exts, _) in LANGUAGES.items() if installed is None or lang in installed for e in exts}
    return found | {e for exts in DEFINITIONS.values() for e in exts} if definitions else found
