"""Profiles of real repositories (D1a-D1h, D3, D4, D6, D11, S3) by the rules of ``rulebook.py``.

Every rule is evaluated where a file is read: a scan yields one small row a manifest or route file, and only those
rows are shuffled, never a text.  Null contents match nothing; repeated rows of one path count once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.operators import rulebook as R
from routelens.operators.detect import exclude_filter
from routelens.sources.corpus import file_extension, glob_to_regex

_SECTIONS = {"npm": ("dependencies", "devDependencies"), "composer": ("require",)}


def _keys(content: Column, sections) -> Column:
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.json_object_keys(F.get_json_object(content, f"$.{s}")), none) for s in sections]
    return F.array_distinct(F.concat(*parts))


def _needle_in(reader: str, needle: str) -> Column:
    if reader in _SECTIONS:
        return F.array_contains("keys", F.lit(needle))
    if reader == "word":
        return F.col("folded").rlike(rf"\b{re.escape(needle)}\b")
    if reader == "gem":
        return F.col("content").rlike(rf"""gem\s+['"]{re.escape(needle)}['"]""")
    return F.col("content").contains(needle)


def _first_rule(reader: str, rules) -> Column:
    """The place of the first rule, in rule order, that a manifest meets."""
    return F.coalesce(*[F.when(_needle_in(reader, r[0]), F.lit(i)) for i, r in enumerate(rules)])


def _place(eco: int, tier: Column, rule: Column) -> Column:
    return F.when(rule.isNotNull(), F.struct(F.lit(eco).alias("eco"), tier.cast("int").alias("tier"), rule.alias("rule")))


def manifest_hits(files: DataFrame, ecosystems=None) -> DataFrame:
    """(repo_id, path, eco, tier, rule, needle, framework, language): the first rule each manifest meets.

    ``files(repo_id, path, content)``, paths relative to the repository's root.  A requirements file also has the rules
    of the files it includes by ``-r`` or ``-c`` (one level, names in lower case as its text is read): words never span
    two files, so the smallest rule of all of them is the joint text's, and no text is joined.
    """
    ecosystems = ecosystems or R.ECOSYSTEMS
    kinds = [path for _, manifests, _ in ecosystems for path, _ in manifests]
    python = next((i for i, e in enumerate(ecosystems) if e[0] == "python"), None)
    path = F.col("path")
    wanted = path.rlike("|".join(f"(?:{k})" for k in kinds))
    code = sorted({e for exts in R.SOURCE_EXTENSIONS.values() for e in exts})
    if python is not None:  # what a requirements file may include: any text that is no source file
        wanted = wanted | ~F.coalesce(file_extension(path).isin(*code), F.lit(False))
    json_kind = F.when(path == "package.json", _keys(F.col("content"), _SECTIONS["npm"])).when(
        path == "composer.json", _keys(F.col("content"), _SECTIONS["composer"]))
    seen = files.where(wanted).select("repo_id", "path", "content", json_kind.alias("keys"), F.lower("content").alias("folded"))
    found = []  # the rules of an ecosystem are listed once for all manifests that are read alike
    for eco, (name, manifests, rules) in enumerate(ecosystems):
        skipped = path.rlike(R.CSHARP_SKIPPED) if name == "csharp" else F.lit(False)
        for reader in dict.fromkeys(r for _, r in manifests):
            tiers = [(p, t) for t, (p, r) in enumerate(manifests) if r == reader]
            tier = F.coalesce(*[F.when(path.rlike(p), F.lit(t)) for p, t in tiers])
            found.append(F.when(tier.isNotNull() & ~skipped, _place(eco, tier, _first_rule(reader, rules))))
    met = [F.struct(F.lit(False).alias("lent"), F.coalesce(*found).alias("h"))]
    if python is not None:
        tier = next(t for t, (p, _) in enumerate(ecosystems[python][1]) if "requirements" in p)
        met.append(F.struct(F.lit(True).alias("lent"), _place(python, F.lit(tier), _first_rule("word", ecosystems[python][2])).alias("h")))
    # exploded, so that no later filter repeats the rules
    rows = seen.select("repo_id", "path", F.explode(F.filter(F.array(*met), lambda m: m["h"].isNotNull())).alias("m"))
    hits = rows.where("not m.lent").select("repo_id", "path", "m.h")
    if python is not None:
        names = F.regexp_extract_all(F.lower("content"), F.lit(r"(?m)^-[rc][^\S\n]+([^\n]+)$"), 1)
        asked = files.where(path == "requirements.txt").select("repo_id", F.explode(names).alias("path"))
        lent = rows.where("m.lent").select("repo_id", "path", "m.h").join(
            asked.select("repo_id", F.trim("path").alias("path")), ["repo_id", "path"], "left_semi")
        hits = hits.unionByName(lent.withColumn("path", F.lit("requirements.txt")))
    rule = F.create_map(*[x for eco, (_, _, rules) in enumerate(ecosystems) for i, r in enumerate(rules)
                          for x in (F.lit(f"{eco}:{i}"), F.struct(*[F.lit(v).cast("string").alias(n) for v, n in
                                                                    zip(r, ("needle", "framework", "language"))]))])
    first = hits.groupBy("repo_id", "path").agg(F.min("h").alias("h")).select("repo_id", "path", "h.*")
    return first.withColumn("r", F.element_at(rule, F.concat_ws(":", "eco", "rule"))).select("*", "r.*").drop("r")


def framework_profile(files: DataFrame, ecosystems=None) -> DataFrame:
    """D1a-D1h, D3, D4: framework and language of every repository that has a manifest of a known kind.

    An ecosystem speaks by its first manifest (in the order of search, then by path) that meets a rule; the first
    ecosystem's framework is the repository's, the others are listed.  A language without a framework (a Go module)
    counts only where no ecosystem has a framework.  JavaScript is TypeScript beside a root ``tsconfig.json``, Java is
    Kotlin in ``build.gradle.kts`` or beside a ``.kt`` file.
    """
    order = F.struct("tier", "path", "rule")
    per_eco = manifest_hits(files, ecosystems).groupBy("repo_id", "eco").agg(
        F.min_by(F.struct("path", "needle", "framework", "language"), order).alias("h"))
    marks = files.select("repo_id", (F.col("path") == "tsconfig.json").alias("ts"), F.col("path").endswith(".kt").alias("kt"))
    marks = marks.where("ts or kt").groupBy("repo_id").agg(F.max("ts").alias("ts"), F.max("kt").alias("kt"))
    x = per_eco.join(marks, "repo_id", "left")
    language = (F.when((F.col("h.language") == "javascript") & F.coalesce("ts", F.lit(False)), "typescript")
                .when((F.col("h.language") == "java") & (F.coalesce("kt", F.lit(False)) | F.col("h.path").endswith(".kts")), "kotlin")
                .otherwise(F.col("h.language")))
    x = x.select("repo_id", "eco", "h.path", "h.needle", "h.framework", language.alias("language"))
    one = F.struct(F.col("framework").isNull().alias("bare"), "eco", "framework", "language", "needle", "path")
    g = x.groupBy("repo_id").agg(F.array_sort(F.collect_list(one)).alias("found"))  # at most one entry an ecosystem
    first = F.element_at("found", 1)
    rest = F.filter(F.slice("found", 2, F.greatest(F.size("found"), F.lit(1))), lambda s: ~s["bare"])
    return g.select(
        "repo_id", first["framework"].alias("framework"), first["language"].alias("language"),
        F.when(~first["bare"], first["needle"]).alias("needle"), first["path"].alias("manifest"),
        F.array_join(F.transform(rest, lambda s: F.concat_ws("/", s["framework"], s["language"])), ", ").alias("others"))


def one_line(pattern: str) -> str:
    """The pattern with its runs of white space kept within a line, as if lines were tested one by one."""
    return re.sub(r"\\s(?=[*+])", lambda _: r"[^\S\n]", pattern)


def route_hits(files: DataFrame, rules=None) -> DataFrame:
    """(repo_id, path, framework, rule_ord): the first rule of every framework that a file meets, excluded files aside.

    One scan for all rules: a file's text is tested only against the patterns of the globs its path fits, and each
    distinct (glob, pattern) once however many frameworks share it.
    """
    shared: dict[str, dict[str, list[tuple[str, int]]]] = {}
    for i, (fw, glob, pattern) in enumerate(rules or R.ROUTE_RULES):
        shared.setdefault(glob, {}).setdefault(pattern, []).append((fw, i))
    none = F.array().cast("array<struct<framework:string,rule_ord:int>>")

    def of(users) -> Column:
        return F.array(*[F.struct(F.lit(fw).alias("framework"), F.lit(i).alias("rule_ord")) for fw, i in users])

    met = [F.when(F.col("path").rlike(glob_to_regex(glob)), F.concat(*[
        F.when(F.col("content").rlike("(?m)" + one_line(p)), of(users)).otherwise(none) for p, users in patterns.items()]))
        .otherwise(none) for glob, patterns in shared.items()]
    hits = exclude_filter(files).select("repo_id", "path", F.explode(F.concat(*met)).alias("h"))
    return hits.groupBy("repo_id", "path", "h.framework").agg(F.min("h.rule_ord").alias("rule_ord"))


def route_files(files: DataFrame, profile: DataFrame, rules=None) -> DataFrame:
    """The files that meet a rule of their repository's framework; the texts stay at the scan."""
    return route_hits(files, rules).join(profile.select("repo_id", "framework").where("framework is not null"),
                                         ["repo_id", "framework"]).select("repo_id", "path", "framework", "rule_ord")


def source_files(files: DataFrame, profile: DataFrame, extensions=None) -> DataFrame:
    """S3: (repo_id, path) of the sources of a repository's language, or of any common one where it is unknown."""
    extensions = extensions or R.SOURCE_EXTENSIONS
    languages = F.create_map(*[x for k, v in extensions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    some = sorted({e for v in extensions.values() for e in v} | set(R.ANY_EXTENSIONS))
    listed = files.select("repo_id", "path").where(file_extension(F.col("path")).isin(*some))
    known = F.coalesce(F.try_element_at(languages, F.col("language")), F.array(*map(F.lit, R.ANY_EXTENSIONS)))
    return (listed.join(profile.select("repo_id", "language"), "repo_id", "left")
            .where(F.array_contains(known, file_extension(F.col("path")))).select("repo_id", "path"))


def server_profile(files: DataFrame, profile: DataFrame) -> DataFrame:
    """(repo_id, port, found_in) of every profiled repository.

    Configuration files come first, in an order that depends on the language, then entry files of the language by path;
    within a file the first rule in rule order.  Without any, the language's usual port and no ``found_in``.
    """
    path = F.col("path")
    config = R.ENVIRONMENT_FILES + R.SPRING_FILES
    base = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    entry = base.rlike("|".join(R.ENTRY_WORDS))
    port = F.coalesce(*[F.nullif(F.regexp_extract("content", rx, 1), F.lit("")).try_cast("int") for _, rx in R.PORT_RULES])
    seen = files.where(path.isin(*config) | entry).select("repo_id", "path", port.alias("port"))
    x = seen.where("port > 0").join(profile.select("repo_id", "language"), "repo_id")
    first_env = F.array(*map(F.lit, config))
    first_jvm = F.array(*map(F.lit, R.SPRING_FILES + R.ENVIRONMENT_FILES))
    place = F.nullif(F.when(F.col("language").isin("java", "kotlin"), F.array_position(first_jvm, path))
                     .otherwise(F.array_position(first_env, path)), F.lit(0))
    languages = F.create_map(*[x for k, v in R.SOURCE_EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fits = entry & F.array_contains(F.try_element_at(languages, F.col("language")), file_extension(path))
    x = x.withColumn("place", F.coalesce(place, F.when(fits, F.lit(len(config) + 1)))).where("place is not null")
    best = x.groupBy("repo_id").agg(F.min_by(F.struct("port", "path"), F.struct("place", "path")).alias("b"))
    ports = F.create_map(*[x for k, v in R.DEFAULT_PORTS.items() for x in (F.lit(k), F.lit(v))])
    usual = F.when(F.col("language").isNotNull(), F.coalesce(F.try_element_at(ports, F.col("language")), F.lit(3000)))
    return profile.select("repo_id", "language").join(best, "repo_id", "left").select(
        "repo_id", F.coalesce("b.port", usual).alias("port"), F.col("b.path").alias("found_in"))
