"""Source files that project descriptions name: module trees and solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize, release

_MOD = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)\s*;"


def declared_modules(files: DataFrame) -> DataFrame:
    """path, child: files (path, content) and the paths a `mod name;` in them can mean, of those that exist."""
    rows = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_MOD), 1))).alias("name"))
    folder, own = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    base = F.when(own.isin("lib", "main", "mod"), folder).otherwise(F.concat(folder, own, F.lit("/")))
    wanted = rows.select("path", F.explode(F.array(F.concat(base, "name", F.lit(".rs")), F.concat(base, "name", F.lit("/mod.rs")))).alias("child"))
    return wanted.join(files.select(F.col("path").alias("child")), "child", "left_semi").select("path", "child")


def module_closure(roots: DataFrame, children: DataFrame) -> DataFrame:
    """path of the roots and of everything they declare, at any depth; one join per level of the module tree."""
    seen = materialize(roots.select("path").distinct(), "modules")
    level = seen
    while True:
        new = level.join(children, "path").select(F.col("child").alias("path")).distinct().join(seen, "path", "left_anti")
        level = materialize(new, "level")
        if level.isEmpty():
            return seen
        more = materialize(seen.unionByName(level), "modules")
        release(seen)
        seen = more


def solution_projects(solutions: DataFrame) -> DataFrame:
    """path, project: projects that .sln and .slnx texts (path, content) name, below the solution's folder."""
    lines = F.regexp_extract_all("content", F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"'), 1)
    tags = F.regexp_extract_all("content", F.lit(r'<Project\b[^>]*\bPath="([^"]+\.csproj)"'), 1)
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    rows = solutions.select("path", folder.alias("folder"), F.explode(F.array_distinct(F.concat(lines, tags))).alias("p"))
    return rows.select("path", F.concat("folder", F.replace("p", F.lit("\\"), F.lit("/"))).alias("project"))


def _below(path: Column, folder: Column) -> Column:
    return F.startswith(path, folder)


def project_sources(projects: DataFrame, files: DataFrame) -> DataFrame:
    """project, path: the C# files (path) below each project's folder, but not below bin, obj or a deeper project."""
    homes = projects.select("project", F.regexp_extract("project", "^(.*/)?[^/]*$", 1).alias("folder")).distinct()
    parts = F.split("path", "/")
    # every folder of a file, so that projects are found by equality and the deepest wins
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    rows = files.where(F.lower("path").rlike(r"\.cs$")).select("path", F.explode(above).alias("folder")).join(homes, "folder")
    best = rows.groupBy("path").agg(F.max(F.struct(F.length("folder").alias("n"), "folder", "project")).alias("b")).select("path", "b.folder", "b.project")
    inner = F.expr("substring(path, length(folder) + 1)")
    return best.where(~inner.rlike("^(bin|obj)/")).select("project", "path")
