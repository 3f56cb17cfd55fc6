"""Import resolution (G11): raw specifiers to the repository's own files.

A specifier depends on its importer only through the importer's folder and
language, so each distinct (keys, folder, language, specifier) is resolved once.
It becomes an ordered list of candidate paths, at most a few dozen:

* JS / TS, relative: the joined and normalised path as it stands, with each
  suffix, as a folder's index file; ``x.js`` may also stand for ``x.ts``.
  Other specifiers: from the root, ``@/`` also from ``src/``.
* Python, dotted: ``a.b`` as ``a/b.py`` or ``a/b/__init__.py`` under the
  importer's folder and each folder above it, the nearest first. Leading dots
  name the folder to start in, one above for each further dot.

Candidates meet the known paths in one equi-join; the first that exists wins.
Specifiers of other packages, and those that leave the root, stay unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normalised(path: Column) -> Column:
    """A relative path without ``.``, ``..`` and empty parts; null if it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def part(acc: Column, x: Column) -> Column:
        up = F.struct(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["ok"] & (F.size(acc["at"]) > 0)).alias("ok"))
        return F.when(x == "..", up).when(x.isin("", "."), acc).otherwise(F.struct(F.array_append(acc["at"], x).alias("at"), acc["ok"].alias("ok")))

    return F.aggregate(F.split(path, "/"), start, part, lambda acc: F.when(acc["ok"], F.array_join(acc["at"], "/")))


def _js_candidates(folder: Column, spec: Column) -> Column:
    joined = F.when(spec.rlike(r"^\.{1,2}(/|$)"), F.array(normalised(F.concat(folder, F.lit("/"), spec))))
    alias = F.when(spec.startswith("@/"), F.array(F.concat(F.lit("src/"), F.substr(spec, F.lit(3))), F.substr(spec, F.lit(3))))
    bases = F.filter(F.coalesce(joined, alias, F.array(normalised(spec))), lambda b: b.isNotNull())

    def forms(base: Column) -> Column:
        stem = F.regexp_replace(base, r"\.[cm]?jsx?$", "")
        index = F.when(base == "", F.lit("index")).otherwise(F.concat(base, F.lit("/index")))
        return F.concat(F.array(base), F.array(*[F.concat(base, F.lit(x)) for x in JS_SUFFIXES]), F.array(*[F.concat(index, F.lit(x)) for x in JS_SUFFIXES]),
                        F.when(stem != base, F.array(*[F.concat(stem, F.lit(x)) for x in (".ts", ".tsx")])).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(bases, forms))


def _py_candidates(folder: Column, spec: Column) -> Column:
    dots = F.length(spec) - F.length(F.ltrim(spec, F.lit(".")))
    rest = F.replace(F.ltrim(spec, F.lit(".")), F.lit("."), F.lit("/"))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    depth = F.size(parts)
    # folders to look in: all from the importer's up to the root, or the one that the dots name
    highest = F.when(dots > 0, F.when(depth - dots + 1 >= 0, F.array(depth - dots + 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(depth, F.lit(0)))

    def forms(n: Column) -> Column:
        at = F.array_join(F.filter(F.concat(F.slice(parts, 1, n), F.array(rest)), lambda x: x != ""), "/")
        package = F.when(at == "", F.lit("__init__.py")).otherwise(F.concat(at, F.lit("/__init__.py")))
        return F.when(rest == "", F.array(package)).otherwise(F.array(F.concat(at, F.lit(".py")), package))

    return F.flatten(F.transform(highest, forms))


def resolve_imports(imports: DataFrame, files: DataFrame, *, keys=("repo_id",), src_col: str = "src", spec_col: str = "dst",
                    path_col: str = "file_path", profile: str = "backend") -> DataFrame:
    """(keys, src, specifier, target): each import with the known file it names, or null.

    ``imports``: (keys, src, dst) with raw specifiers; ``files``: (keys, file_path), the known paths."""
    keys = list(keys)
    lang = S.detect_language("src", profile)
    rows = imports.select(*keys, F.col(src_col).alias("src"), F.col(spec_col).alias("specifier")).distinct()
    rows = rows.withColumn("_folder", _folder(F.col("src"))).withColumn("_py", F.coalesce(lang == "python", F.lit(False)))
    case = [*keys, "_folder", "_py", "specifier"]
    cases = rows.select(*case).distinct().where(F.col("specifier").isNotNull())
    options = F.when(F.col("_py"), _py_candidates(F.col("_folder"), F.col("specifier"))).otherwise(_js_candidates(F.col("_folder"), F.col("specifier")))
    tried = cases.select(*case, F.posexplode(options).alias("_nth", "target"))
    known = files.select(*keys, F.col(path_col).alias("target")).where("target is not null").distinct()
    found = tried.join(known, [*keys, "target"]).groupBy(*case).agg(F.min_by("target", "_nth").alias("target"))
    return rows.join(found, case, "left").select(*keys, "src", "specifier", "target")


def file_edges(resolved: DataFrame, keys=("repo_id",)) -> DataFrame:
    """(keys, src, dst): import edges between files; unresolved specifiers keep their text."""
    return resolved.select(*keys, "src", F.coalesce("target", "specifier").alias("dst")).distinct()
