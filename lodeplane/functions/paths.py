"""Paths of source files (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file ending (fixed values).
LANGUAGE_OF = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "rs": "rust", "cs": "csharp", "swift": "swift", "dart": "dart", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "sh": "shell", "css": "css"}

#: Four notions of a test path, each used by its own operator (fixed values).
TEST_PATHS = {
    "impact": r"(?i)[/\\](tests?|__tests?__|spec)[/\\]|\.test\.|\.spec\.",
    "health": r"(^|/)__tests?__/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)tests?/|(Tests?|TestSuite)\.(java|kt|cs|py|rb|go|rs|swift)$|(^|/)(test_[^/]*|conftest)\.py$|(^|/)[^/]*_test\.(py|go|rb)$",
    "review": r"(?i)(\.|_)(test|spec)\.|(^|/)(tests?|specs?|__tests__|cypress|e2e|fixtures?)/",
    "vendored": r"(?i)(^|/)(vendor|compiled|third[_-]party|bower_components|jspm_packages)(/)|\.min\.(js|css|mjs|cjs)$",
}
#: What keeps a file out of the grouping into features (fixed values).
TOOL_DIRS = r"(^|/)(tests|test|__tests__|__test__|e2e|cypress|playwright|fixtures|mocks|__mocks__|support|spec|specs)/"
TEST_NAME = r"\.test\.|\.spec\.|\.e2e\.|-test\.|\.mock\."
CONFIG_NAME = r"^(jest|vitest|babel|webpack|rollup|esbuild|tsconfig|eslint|prettier|tailwind|postcss|vite)[.-]"
SETUP_NAME = r"^(setup|teardown|global-setup|global-teardown|test-setup|test-teardown)\.\w+$"
ENTRY_NAME = r"^(main|app|index|server|bootstrap)\.\w+$"
SEED_PATH = r"/seed\.\w+$|/seeds/|/migrations/"


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column | str) -> Column:
    """The path up to its last slash, empty for a bare name."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def language(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("other"))


def is_test(path: Column | str, notion: str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(TEST_PATHS[notion])


def clusterable(path: Column | str, has_entry_points: Column) -> Column:
    """Whether a file counts for features; seeds and root entry files do if they hold entry points."""
    p = F.col(path) if isinstance(path, str) else path
    name = basename(p)
    out = p.rlike(TOOL_DIRS) | name.rlike(TEST_NAME) | name.rlike(CONFIG_NAME) | name.rlike(SETUP_NAME) | name.rlike("[mM]ock")
    spared = has_entry_points | ~(p.rlike(SEED_PATH) | ((F.size(F.split(p, "/")) <= 2) & name.rlike(ENTRY_NAME)))
    return ~out & spared


def prefixes(path: Column | str) -> Column:
    """Every directory prefix of a path, the empty one included: the keys of an equi-join in place of ``startswith``."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def suffixes(path: Column | str) -> Column:
    """Every suffix of a path that starts at a segment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def resolved(base: Column | str, relative: Column | str) -> Column:
    """A relative path against a directory, with ``.`` and ``..`` worked off segment by segment."""
    joined = F.concat_ws("/", F.nullif(base if isinstance(base, Column) else F.col(base), F.lit("")), relative)

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(seg.isin("", "."), acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    return F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
