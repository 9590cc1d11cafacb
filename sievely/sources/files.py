"""Files as a DataFrame: skip rules as Columns, a lister that honours ignore files, reading and decoding."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .ledger import shared_dir

#: Directories, names and endings that are not searched.
SKIP_DIRS = [".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", "target", ".next", ".nuxt", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "vendor", ".idea", ".vscode", "coverage", ".terraform"]
SKIP_NAMES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "Cargo.lock", "poetry.lock", "uv.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "go.sum", "flake.lock"]
SKIP_SUFFIXES = [".min.js", ".min.css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".pdf", ".zip", ".gz", ".tar", ".tgz", ".bz2", ".xz", ".7z", ".jar", ".war", ".class", ".so", ".dylib", ".dll", ".exe", ".o", ".a", ".wasm", ".pyc", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp3", ".mp4", ".mov", ".avi", ".webm", ".bin", ".dat", ".db", ".sqlite", ".parquet", ".npy", ".npz", ".pkl", ".onnx", ".pt", ".safetensors", ".snap"]
MAX_BYTES = 512_000


def wanted(path: Column, length: Column, globs: list[str] = (), excludes: list[str] = (), max_bytes: int = MAX_BYTES, hidden: bool = False, explicit: Column | None = None) -> Column:
    """The scan's predicate on paths below the root: skip rules, globs and size, then excludes; explicit files meet excludes only."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    keep = ~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIP_DIRS))) & ~name.isin(SKIP_NAMES)
    keep = keep & ~F.lower(name).rlike("(?:" + "|".join(map(re.escape, SKIP_SUFFIXES)) + ")$") & length.between(1, max_bytes)
    if not hidden:
        keep = keep & ~path.rlike(r"(?:^|/)\.")
    if globs:
        keep = keep & tx.path_matches(path, list(globs))
    if explicit is not None:
        keep = keep | explicit
    return keep & ~tx.path_matches(path, list(excludes)) if excludes else keep


class Ignore:
    """One ignore file's patterns, by the public rules of gitignore: later lines win, ! takes back, / anchors."""

    def __init__(self, folder: str, text: str):
        self.folder, self.rules = folder, []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            line = line[1:] if back or line.startswith(("\\#", "\\!")) else line
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(self._regex(line.lstrip("/"), anchored)), only_dir, back))

    @staticmethod
    def _regex(pattern: str, anchored: bool) -> str:
        out, i = [], 0
        while i < len(pattern):
            if pattern.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
            elif pattern.startswith("**", i):
                out.append(".*")
                i += 2
            elif pattern[i] == "*":
                out.append("[^/]*")
                i += 1
            elif pattern[i] == "?":
                out.append("[^/]")
                i += 1
            elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
                out.append(fnmatch.translate(pattern[i : end + 1])[4:-3])
                i = end + 1
            else:
                i += pattern[i] == "\\" and i + 1 < len(pattern)
                out.append(re.escape(pattern[i]))
                i += 1
        return ("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z"

    def says(self, path: str, is_dir: bool) -> bool | None:
        relative, found = os.path.relpath(path, self.folder).replace(os.sep, "/"), None
        for regex, only_dir, back in self.rules:
            if (is_dir or not only_dir) and regex.match(relative):
                found = not back
        return found


@dataclass
class Discover:
    globs: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    max_bytes: int = MAX_BYTES
    hidden: bool = False
    no_ignore: bool = False


#: Names that a task lists below a directory before it hands the directories that are left on to the next round.
WALK_ENTRIES = 20_000
_CHAIN = "array<struct<folder:string,text:string>>"
_ENTRY = f"kind string, root int, path string, chain {_CHAIN}, length long, canonical string"
_ENTRY_TYPES = {
    "kind": pa.string(), "root": pa.int32(), "path": pa.string(), "chain": pa.list_(pa.struct([("folder", pa.string()), ("text", pa.string())])), "length": pa.int64(), "canonical": pa.string(),
}


def _ignores(folder: str, paths: list[str] | None = None) -> list[dict]:
    """The ignore files that are there, as data, for paths below folder; later ones win."""
    found = []
    for path in paths or [os.path.join(folder, name) for name in (".gitignore", ".ignore")]:
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                found.append({"folder": folder, "text": f.read()})
    return found


def _above(root: str) -> list[dict]:
    """What ignore files of root's parents say, up to the repository's top, and of the user and the repository as a whole."""
    top, parents = os.path.abspath(root), []
    while not os.path.isdir(os.path.join(top, ".git")):
        if os.path.dirname(top) == top:
            return []
        top = os.path.dirname(top)
        parents.append(top)
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    whole = _ignores(top, [os.path.join(config, "git", "ignore"), os.path.join(top, ".git", "info", "exclude")])
    return whole + [x for folder in reversed(parents) for x in _ignores(folder)]


@lru_cache(maxsize=4096)
def _parsed(folder: str, text: str) -> Ignore:
    return Ignore(folder, text)


def _listed(row: dict, honour: bool, hidden: bool, most: int) -> Iterator[tuple]:
    """Files below a directory, and the directories that are left when `most` names have been seen; symbolic links are followed to files only."""
    left, seen = [(row["path"], row["chain"])], 0
    while left:
        folder, chain = left.pop()
        if seen >= most:
            yield "dir", row["root"], folder, chain, None, None
            continue
        chain = chain + _ignores(folder) if honour else chain
        rules = [_parsed(x["folder"], x["text"]) for x in reversed(chain)]
        names = os.listdir(folder)
        seen += len(names)
        for name in names:
            path = os.path.join(folder, name)
            is_dir = os.path.isdir(path) and not os.path.islink(path)
            if (not hidden and name.startswith(".")) or (is_dir and name in SKIP_DIRS):
                continue
            if next((v for x in rules if (v := x.says(path, is_dir)) is not None), False):
                continue
            if is_dir:
                left.append((path, chain))
            elif os.path.isfile(path):
                yield "file", row["root"], path, None, os.path.getsize(path), os.path.realpath(path)


def _walked(roots: DataFrame, honour: bool, hidden: bool, most: int) -> DataFrame:
    """Files below roots (root, path, chain), listed in rounds: what a round leaves is dealt among all tasks of the next, with the ignore files that hold there."""
    spark = roots.sparkSession
    folder, rounds = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}", 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (entry for row in batch.to_pylist() for entry in _listed(row, honour, hidden, most))
            while part := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _ENTRY_TYPES.values(), strict=True)], list(_ENTRY_TYPES))

    frontier = roots
    while True:
        frontier.select("root", "path", "chain").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, _ENTRY).write.parquet(f"{folder}/round={rounds}")
        frontier = spark.read.schema(_ENTRY).parquet(f"{folder}/round={rounds}").where("kind = 'dir'")
        rounds += 1
        if frontier.isEmpty():
            return spark.read.schema(_ENTRY).parquet(*(f"{folder}/round={k}" for k in range(rounds))).where("kind = 'file'")


def _shown(cwd: str):
    """How a path is shown: relative to the working folder when inside it, else as it was spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            whole = [os.path.normpath(os.path.join(cwd, p)) for p in paths]
            near = [os.path.relpath(p, cwd) for p in whole]
            shown = [(p if x.startswith("..") or x == "." else x).replace(os.sep, "/") for p, x in zip(paths, near, strict=True)]
            held = batch.set_column(batch.schema.get_field_index("path"), "path", pa.array(shown, pa.string()))
            yield held.append_column("location", pa.array(whole, pa.string()))

    return run


def discover(spark: SparkSession, paths: list[str], options: Discover = Discover(), most: int = WALK_ENTRIES) -> DataFrame:
    """files: ord, path (as shown), location, length - each file once, by the order of paths and then of names. FileNotFoundError for a path that is not there.

    The driver looks at the paths that are named; what is below them is listed by tasks, which must reach the same folders.
    """
    named, roots = [], []
    for k, raw in enumerate(paths or ["."]):
        if os.path.isfile(raw):
            named.append((k, raw, "", True, os.path.getsize(raw), os.path.realpath(raw)))
        elif os.path.isdir(raw):
            roots.append((k, os.path.abspath(raw), raw))
        else:
            raise FileNotFoundError(raw)
    df = spark.createDataFrame(named, "root int, path string, inner string, explicit boolean, length long, canonical string")
    if roots:
        spelled = F.create_map(*(F.lit(x) for k, _, raw in roots for x in (k, raw)))
        tops = F.create_map(*(F.lit(x) for k, top, _ in roots for x in (k, top)))
        rows = lambda some, above: spark.createDataFrame([(k, top, _above(raw) if above else []) for k, top, raw in some], f"root int, path string, chain {_CHAIN}")
        found = _walked(rows(roots, not options.no_ignore), not options.no_ignore, options.hidden, most)
        if not options.no_ignore:
            # A root of which all is ignored was meant: it is walked again as it is. (One row per path that was named.)
            full = {x["root"] for x in found.select("root").distinct().collect()}
            if empty := [x for x in roots if x[0] not in full]:
                found = found.unionByName(_walked(rows(empty, False), False, options.hidden, most))
        inner = F.regexp_replace(F.substr("path", F.length(tops[F.col("root")]) + 1), "^/+", "")
        mine = F.when(spelled[F.col("root")].endswith("/"), spelled[F.col("root")]).otherwise(F.concat(spelled[F.col("root")], F.lit("/")))
        df = df.unionByName(found.select("root", F.concat(mine, inner).alias("path"), inner.alias("inner"), F.lit(False).alias("explicit"), "length", "canonical"))
    df = df.mapInArrow(_shown(os.getcwd()), "root int, path string, inner string, explicit boolean, length long, canonical string, location string")
    keep = wanted(F.col("inner"), F.col("length"), max_bytes=options.max_bytes, hidden=options.hidden)
    if options.globs:
        keep = keep & tx.path_matches(F.col("path"), options.globs)
    keep = keep | F.col("explicit")
    if options.excludes:
        keep = keep & ~tx.path_matches(F.col("path"), options.excludes)
    place = F.struct("root", F.split("inner", "/").alias("names"))
    first = df.where(keep).groupBy("canonical").agg(F.min_by(F.struct(place.alias("place"), "path", "location", "length"), place).alias("f"))
    # Numbers in that order; they have gaps where partitions meet.
    ordered = first.select("f.*").orderBy("place").select("path", "location", "length", F.monotonically_increasing_id().alias("ord"))
    folder = f"{shared_dir(spark)}/listed-{uuid.uuid4().hex}"
    ordered.write.parquet(folder)
    return spark.read.schema(ordered.schema).parquet(folder).select("ord", "path", "location", "length")


def read_files(listed: DataFrame, unreadable=None) -> DataFrame:
    """path, text of listed files that are text (no NUL in the first 8,192 bytes), decoded with replacement.

    unreadable: an accumulator that counts files that could not be read; without one they are an error.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, location in zip(batch["path"], batch["location"], strict=True):
                try:
                    with open(location, "rb") as f:
                        data = f.read()
                except OSError:
                    if unreadable is None:
                        raise
                    unreadable.add(1)
                    continue
                if b"\0" not in data[:8192]:
                    out.append((path, data.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["path", "text"])

    return listed.select("path", "location").mapInPandas(run, "path string, text string")


def read_store(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, text of a store that only Spark reads; sizes are pruned before contents are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    df = df.where(F.col("length").between(1, max_bytes))
    binary = F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\0") > 0
    return df.where(~binary).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


#: What a core reads without another one's help: a table of fewer files that holds less for each core is dealt out.
ROW_GROUP_BYTES = 128 << 20


def dealt(table: DataFrame) -> DataFrame:
    """A table as it was read, in as many partitions as there are cores if it is small and in few files.

    A row group is one task, so a small file is read by one core, which then does all the work of the stages that need no
    shuffle. Dealing its rows out costs at most ROW_GROUP_BYTES a core; larger tables, and those of many files, stay as they are.
    """
    spark = table.sparkSession
    cores, paths = spark.sparkContext.defaultParallelism, table.inputFiles()
    if not paths or len(paths) >= cores:
        return table
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    size = sum(path(p).getFileSystem(conf).getFileStatus(path(p)).getLen() for p in paths)
    return table.repartition(cores) if size <= cores * ROW_GROUP_BYTES else table
