"""Files that are not hand-written by the repository's own developers.

Told first by the layout: maximum and mean line length, shares of white space, letters and digits, density of numeric
literals, and long encoded runs, with thresholds per language (``LAYOUT``). What a tool or a third party wrote in the
layout of common code is told by a banner in the comment lines at the head, however many they are, and by the path (places for
third-party code and build output, lock files, marks in the name). All of it is built-in column expressions, evaluated in
one narrow pass without Python; the only join is with the few repositories whose root lies in a place for third-party code.

An inlined image is taken out before the layout is measured, so that one icon does not make data of a file. Files in
configuration formats are never judged by layout. Null contents are judged by their path alone; a null path by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directories for third-party code, whole segments of a path (fixed values).
THIRD_PARTY = "third_party third-party thirdparty 3rdparty vendor _vendor node_modules bower_components jspm_packages Pods Carthage Godeps .venv venv site-packages extern external externals deps compiled vendored upstream".split()
#: Directories for output of tools, whole segments of a path (fixed values).
OUTPUT = "generated __generated__ generated-sources generated-test-sources gen dist .next .nuxt obj __pycache__ .gradle .tox".split()
#: Lock files of package managers (fixed values).
LOCKS = "package-lock.json packages.lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock Cargo.lock poetry.lock Pipfile.lock go.sum uv.lock bun.lockb flake.lock mix.lock pubspec.lock Podfile.lock gradle.lockfile".split()


def _segments(names: list[str]) -> str:
    return "(^|/)(" + "|".join(n.replace(".", "\\.") for n in names) + ")/"


PLACES = _segments(THIRD_PARTY)
OUTPUTS = _segments(OUTPUT) + r"|^(build|target|out)/|(^|/)(bin|obj)/(Debug|Release)/|(^|/)target/(classes|generated[^/]*)/"
NAMES = r"\.min\.(js|mjs|css)$|[.-]bundle\.js$|\.(js|css)\.map$|_pb2(_grpc)?\.pyi?$|\.pb\.go$|\.pb\.(cc|h)$|\.g\.(dart|cs)$|\.designer\.cs$|[._]gen(erated)?\.(ts|js|go|py|java)$|(^|/)zz_generated[^/]*\.go$"
LOCKED = "(^|/)(" + "|".join(n.replace(".", "\\.") for n in LOCKS) + ")$"
CODE = r"\.(py|js|mjs|cjs|ts|tsx|jsx|go|java|rb|php|c|h|cc|cpp|cs|rs|kt|swift|scala|css)$"
#: The first line that is neither blank nor a comment, a shebang or a byte-order mark: there the head of a file ends.
HEAD_ENDS = r"^[ \t\x{FEFF}]*(?:[^\s\x{FEFF}#/*<;-]|/[^/*]|<[^!]|-[^-])"
TOOL = r"(?i)@generated\b|<auto-?generated|auto-?generated\b|automatically generated|generated (by|from|at|with|using)\b|do not (edit|modify)\b|machine generated"
COPY = r"(?i)(^|[/#*!;-])\s*!?\s*[a-z][\w.@/-]* v?\d+\.\d+(\.\d+)?\b[^\r\n]*(\(c\)|licen[sc]e|copyright|upstream|bundled|https?://)|upstream copy|bundled from|vendored (from|copy)|\(c\) [^\r\n]* contributors"
IMAGE = r"data:[a-z]+/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=]+"
RUN = r"[A-Za-z0-9+/=_-]{120,}|(?:\\x[0-9a-fA-F]{2}){40,}"

#: Per language, by the endings of its files: the mean line from which code is squeezed, and the greatest share of white space
#: it then has. The mean is about three times what 999 of 1,000 hand-written files of the language stay below, white
#: space about half of what they have at least.
LAYOUT = {"py": (180, 0.10), "js|mjs|cjs|jsx": (160, 0.10), "ts|tsx": (160, 0.10), "go": (120, 0.10), "java": (160, 0.12), "css": (80, 0.12)}
OTHER = (240, 0.10)
LONG_LINE = 400  # least length of the longest line of squeezed code, twice what hand-written code has
LONG_SHARE = 0.65  # more than an inlined key makes of a small file; share of the text in such lines from which their own white space decides, whatever the mean
LEAST_CHARS = 200
RUN_SHARE = 0.4  # share of the text in long encoded runs, and
ALNUM_SHARE = 0.8  # of letters and digits among the visible characters, from which it is data
DIGIT_SHARE = 0.45  # share of digits among the visible characters from which it is data
NUMBER_DENSITY = 0.6  # numeric literals among all words and literals


def plain_text(content: Column | str) -> Column:
    """A text with one kind of line end and without inlined images."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit("")), IMAGE, "data:"), r"\r\n?", "\n")


def layout(text: Column | str) -> dict[str, Column]:
    """Layout statistics of a plain text: columns by name; and ``head``, its leading comment lines."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.greatest(F.length(text), F.lit(1))
    visible = F.greatest(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(1))
    share = lambda pattern, of: (n - F.length(F.regexp_replace(text, pattern, ""))) / of
    long = F.regexp_replace(text, f"(?m)^[^\\n]{{0,{LONG_LINE - 1}}}$", "")  # the long lines alone
    ends = F.regexp_instr(text, F.lit("(?m)" + HEAD_ENDS))
    return {
        "chars": F.length(text),
        "long_share": share(f"[^\\n]{{{LONG_LINE},}}", n),
        "long_blank": F.length(F.regexp_replace(long, r"[^\s]+|\n", "")) / F.greatest(F.length(F.regexp_replace(long, r"\n", "")), F.lit(1)),
        "mean_line": n / F.greatest(F.regexp_count(text, F.lit(r"[^\n]+")), F.lit(1)),
        "blank_share": 1 - visible / n,
        "alnum_share": share(r"[A-Za-z0-9]+", visible),
        "digit_share": share(r"[0-9]+", visible),
        "number_density": F.regexp_count(text, F.lit(r"\b[0-9][0-9A-Fa-fxX_.]*\b")) / F.greatest(F.regexp_count(text, F.lit(r"\w+")), F.lit(1)),
        "run_share": share(RUN, n),
        "head": F.when(ends > 0, F.substring(text, F.lit(1), ends - 1)).otherwise(text),
    }


def _reason(path: Column, s: dict[str, Column]) -> Column:
    def squeezed(mean: float, blank: float) -> Column:
        return (s["long_share"] > 0) & (((s["mean_line"] >= mean) & (s["blank_share"] <= blank)) | ((s["long_share"] >= LONG_SHARE) & (s["long_blank"] <= blank)))

    rule = F
    for endings, limits in LAYOUT.items():
        rule = rule.when(path.rlike(rf"\.({endings})$"), squeezed(*limits))
    numbers = (s["digit_share"] >= DIGIT_SHARE) & (s["number_density"] >= NUMBER_DENSITY)
    encoded = (s["run_share"] >= RUN_SHARE) & (s["alnum_share"] >= ALNUM_SHARE)
    judged = path.rlike(CODE) & (s["chars"] >= LEAST_CHARS)
    return (
        F.when(judged & (encoded | numbers), "data").when(judged & rule.otherwise(squeezed(*OTHER)), "squeezed")
        .when(s["head"].rlike(TOOL), "banner").when(s["head"].rlike(COPY), "copy")
        .when(path.rlike(PLACES), "place").when(path.rlike(OUTPUTS), "output").when(path.rlike(LOCKED), "lock").when(path.rlike(NAMES), "name")
    )


def judged_files(files: DataFrame, *, path: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep`` (renamed ``k0``, ``k1`` ...), the layout of each file and ``reason``: data, squeezed, banner, copy,
    place, output, lock or name, null for a hand-written file. Text, statistics and reason are three projections, so that
    each is computed once."""
    kept = [f"k{i}" for i in range(len(keep))]
    slim = files.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.coalesce(F.col(path), F.lit("")).alias("_path"), plain_text(content).alias("_text"))
    measured = slim.select(*kept, "_path", *[c.alias(k) for k, c in layout("_text").items()])
    return measured.withColumn("reason", _reason(F.col("_path"), {k: F.col(k) for k in measured.columns})).drop("_path", "head")


def foreign_repositories(repos: DataFrame) -> DataFrame:
    """Ids of the repositories whose root lies in a place for third-party code."""
    return repos.where(F.concat(F.col("root_path"), F.lit("/")).rlike(PLACES)).select("repo_id").distinct()


def foreign_files(files: DataFrame, repos: DataFrame, *, key: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """``key`` and ``reason`` of the files that are not hand-written, each record once."""
    why = judged_files(files, path=path, content=content, keep=(key, "repo_id")).select(F.col("k0").alias("key"), F.col("k1").alias("repo_id"), "reason")
    roots = foreign_repositories(repos).withColumn("foreign", F.lit(True))
    judged = why.join(roots, "repo_id", "left").select("key", F.when(F.col("foreign"), "root").otherwise(F.col("reason")).alias("reason"))
    return judged.where("reason is not null").groupBy(F.col("key").alias(key)).agg(F.min("reason").alias("reason"))


def handwritten_files(files: DataFrame, repos: DataFrame, *, key: str = "file_id") -> DataFrame:
    """The rows of ``files`` that remain, with all their columns; rows without a key are kept."""
    out = foreign_files(files, repos, key=key).select(F.col(key).alias("_foreign"))
    return files.join(out, files[key] == F.col("_foreign"), "left_anti")
