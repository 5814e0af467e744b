"""Document rules (E, K) and the pipeline of their findings (F).

A target is a row ``project, rel, kind, category, content``; a rule is a function from the
targets and a context to findings ``rule, severity, action, place, what, fix_old, fix_new``.
Rules are listed in a registry and joined by union; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.functions import text as tx
from quern.functions.overlaps import overlapping
from quern.session import cut_lineage, evaluated, ship, table

#: Grade of a severity, and the actions a summary counts.
SEVERITY_RANK = {"BLOCK": 0, "WARN": 1, "INFO": 2}
ACTIONS = ("AUTO_FIX", "NEEDS_JUDGMENT", "REPORT_ONLY")
UNKNOWN_RANK = 9
WITHHELD = "(line withheld)"
OVERLAP = 0.2
FEW = 4096  # pairs of a project that are compared by a join
#: Kinds of file meant for any runtime, and required and known entries of a memory.
NEUTRAL_KINDS = ("agents_md", "project_md")
MEMORY_KEYS = ("name", "description")
MEMORY_TYPES = ("feedback", "project", "reference", "session", "user")
NGRAM = 12
PROSE_SHARE = 0.6


def targets_of(documents: DataFrame) -> DataFrame:
    """Documents as targets; notes of an iteration stand for memories, a source for a project."""
    kind = F.when(F.col("doc_kind") == "instruction", "project_md").when(F.col("doc_kind") == "iteration_note", "memory").otherwise(F.col("doc_kind"))
    category = F.when(F.col("doc_kind") == "iteration_note", "memory").otherwise("instruction")
    return documents.select(F.coalesce("source", F.lit("")).alias("project"), F.concat_ws("#", F.coalesce("path", F.lit("")), F.col("doc_id").cast("string")).alias("rel"), "path", "skill_name", kind.alias("kind"), category.alias("category"), F.col("text").alias("content"))


def log_targets(session: DataFrame, part: DataFrame, stored: DataFrame) -> DataFrame:
    """What was logged, as targets: stored sessions and said parts as memories, tool calls on a path as notes for any runtime.

    A stored session is a front matter of its slug, title and version, a part is a memory of its session, and a
    line's calls are one note, a call a line. Unreadable JSON, and calls without name or path, make none.
    """
    empty = F.lit(None).cast("string")
    shape = lambda project, name, kind, category, content: (F.coalesce(project, F.lit("")).alias("project"), F.concat(F.lit(name + "#"), F.col("row_id").cast("string")).alias("rel"), empty.alias("path"), empty.alias("skill_name"), F.lit(kind).alias("kind"), F.lit(category).alias("category"), content.alias("content"))
    entries = F.concat_ws("\n", *(F.concat(F.lit(key + ": "), F.col(c)) for key, c in (("name", "slug"), ("description", "title"), ("type", "version"))))
    sessions = stored.select(*shape(F.col("directory"), "session", "memory", "memory", F.concat(F.lit("---\n"), entries, F.lit("\n---\n"))))
    get = lambda v, at, kind="string": F.try_variant_get(v, at, kind)
    lines = evaluated(session.where(F.contains("message.content", F.lit("tool_use"))).select("row_id", "cwd", F.col("message.content").alias("content")), {"v": F.try_parse_json("content")})
    called = F.transform(F.filter(get(F.col("v"), "$", "array<variant>"), lambda b: get(b, "$.type") == "tool_use"), lambda b: F.concat(F.lit("`"), get(b, "$.name"), F.lit("` on `"), get(b, "$.input.path"), F.lit("`")))
    notes = evaluated(lines, {"called": F.array_compact(called)}).where("size(called) > 0").select(*shape(F.col("cwd"), "line", "agents_md", "instruction", F.array_join("called", "\n")))
    parts = evaluated(part.select("row_id", "session_id", "data"), {"v": F.try_parse_json("data")})
    parts = evaluated(parts, {"d": F.when(F.schema_of_variant("v") == "STRING", F.try_parse_json(get(F.col("v"), "$"))).otherwise(F.col("v"))})
    text = get(F.col("d"), "$.text", "variant")
    said = parts.where((get(F.col("d"), "$.type") == "text") & (F.schema_of_variant(text) == "STRING")).select(*shape(F.col("session_id"), "part", "memory", "memory", get(F.col("d"), "$.text")))
    return sessions.unionByName(notes).unionByName(said)


def paths_of(targets: DataFrame) -> DataFrame:
    """Files and directories that exist, per project."""
    files = targets.where("path is not null").select("project", "path").distinct()
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), i), "/"))
    dirs = files.where("contains(path, '/')").select("project", F.explode(parents).alias("path")).distinct()
    return files.withColumn("is_dir", F.lit(False)).unionByName(dirs.withColumn("is_dir", F.lit(True)))


def finding(rule: str, severity, action, place, what, old=None, new=None):
    """One finding as columns."""
    as_col = lambda v: v if not isinstance(v, str) and v is not None else F.lit(v).cast("string")
    return [F.lit(rule).alias("rule"), as_col(severity).alias("severity"), as_col(action).alias("action"), place.alias("place"), what.alias("what"), as_col(old).alias("fix_old"), as_col(new).alias("fix_new")]


def _place():
    return F.concat_ws(":", "rel", F.col("line_no").cast("string"))


def path_references(targets: DataFrame) -> DataFrame:
    """References shaped like paths: links first, then code spans, per line."""
    lines = tx.exploded_lines(targets, ["project", "rel", "kind", "category"])
    links = F.transform(F.regexp_extract_all("line", F.lit(r"\]\(([^)\s#]+)\)"), F.lit(1)), lambda r: F.struct(r.alias("ref"), F.lit("link").alias("form")))
    spans = F.transform(F.regexp_extract_all("line", F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda r: F.struct(F.trim(r).alias("ref"), F.lit("code_span").alias("form")))
    rows = lines.select("project", "rel", "kind", "category", "line_no", F.explode(F.concat(links, spans)).alias("r")).select("project", "rel", "kind", "category", "line_no", "r.ref", "r.form")
    return rows.where(tx.is_pathish(F.col("ref")))


def missing_references(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """References that name nothing that exists (a final slash is ignored)."""
    known = paths.select("project", F.col("path").alias("norm")).distinct()
    return refs.withColumn("norm", F.regexp_replace("ref", r"/+$", "")).join(known, ["project", "norm"], "left_anti")


def checkable_references(missing: DataFrame, paths: DataFrame) -> DataFrame:
    """Links, and code spans with an extension whose directory exists or whose name is nowhere in the project.

    All names of a project are looked at, however many they are.
    """
    dirs = paths.where("is_dir").select("project", F.col("path").alias("parent")).distinct().withColumn("has_parent", F.lit(True))
    names = paths.where("not is_dir").select("project", tx.base_name(F.col("path")).alias("base")).distinct().withColumn("has_name", F.lit(True))
    df = missing.withColumns({"parent": tx.dir_name(F.col("norm")), "base": tx.base_name(F.col("norm"))})
    df = df.join(dirs, ["project", "parent"], "left").join(names, ["project", "base"], "left")
    span_ok = F.col("base").rlike(r"\.[A-Za-z0-9]+$") & (F.col("has_parent").isNotNull() | F.col("has_name").isNull())
    return df.where((F.col("form") == "link") | span_ok)


def near_neighbours(missing: DataFrame, paths: DataFrame) -> DataFrame:
    """The only entry beside a reference at an edit distance of one at most."""
    beside = paths.select("project", tx.dir_name(F.col("path")).alias("parent"), tx.base_name(F.col("path")).alias("neighbour"))
    pairs = missing.select("project", "parent", "base").distinct().join(beside, ["project", "parent"]).where(F.levenshtein("base", "neighbour", 1) != -1)
    return pairs.groupBy("project", "parent", "base").agg(F.count_distinct("neighbour").alias("n"), F.min("neighbour").alias("neighbour")).where("n = 1").drop("n")


def is_project_instruction():
    """E23."""
    return (F.col("category") == "instruction") & ~F.col("kind").isin("global_claude_md", "global_rules")


def rule_missing_path(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """A reference to a file that is not there; fixed if exactly one neighbour fits."""
    lost = checkable_references(missing_references(path_references(targets.where(is_project_instruction())), paths), paths)
    fixed = lost.join(near_neighbours(lost, paths), ["project", "parent", "base"], "left")
    new = F.when(F.col("neighbour").isNotNull(), F.when(F.col("parent") == "", F.col("neighbour")).otherwise(F.concat_ws("/", "parent", "neighbour")))
    return fixed.select(*finding("CA-S001", "WARN", F.when(F.col("neighbour").isNotNull(), "AUTO_FIX").otherwise("NEEDS_JUDGMENT"), _place(), F.concat(F.lit("missing path "), F.col("ref")), F.when(F.col("neighbour").isNotNull(), F.col("ref")), new))


def rule_missing_skill(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """A mention of ``skills/<name>/`` that is no known skill of the project."""
    known = targets.where("skill_name is not null").select("project", F.col("skill_name").alias("name")).distinct()
    lines = tx.exploded_lines(targets.where(is_project_instruction()), ["project", "rel"])
    named = lines.select("project", "rel", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\bskills/([a-z][a-z0-9-]*)/"), F.lit(1))).alias("name")).where("name <> 'shared'")
    return named.join(known, ["project", "name"], "left_anti").select(*finding("CA-S002", "WARN", "NEEDS_JUDGMENT", _place(), F.concat(F.lit("missing skill "), F.col("name"))))


def rule_unsafe(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """The first kind of unsafe wording in a line; a memory's line is withheld."""
    label = F.coalesce(*(F.when(F.col("line").rlike(p), name) for name, p in tx.UNSAFE))
    lines = tx.exploded_lines(targets, ["rel", "category"]).withColumn("label", label).where("label is not null")
    shown = F.when(F.col("category") == "memory", WITHHELD).otherwise(F.trim("line"))
    return lines.select(*finding("CA-U001", "WARN", "REPORT_ONLY", _place(), F.concat_ws(": ", "label", shown)))


def rule_runtime_tools(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """Tool names of one runtime in a file meant for any; the first in a line."""
    tools = "|".join(tx.RUNTIME_TOOLS)
    pattern = rf"`({tools})`|\b({tools})\s+tool\b|\b({tools})\s*ツール"
    lines = tx.exploded_lines(targets.where(F.col("kind").isin(*NEUTRAL_KINDS)), ["rel"]).where(F.col("line").rlike(pattern))
    tool = F.concat(*(F.regexp_extract("line", pattern, i) for i in (1, 2, 3)))
    return lines.select(*finding("CA-D001", "INFO", "REPORT_ONLY", _place(), F.concat(F.lit("runtime tool "), tool)))


def rule_unmentioned_skill(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """A skill of the project that no instruction names, names being cut at anything but letters, digits and hyphens."""
    known = targets.where("skill_name is not null").select("project", F.col("skill_name").alias("name")).distinct()
    words = targets.where(is_project_instruction() & F.col("content").isNotNull()).select("project", F.explode(F.array_distinct(F.split("content", "[^A-Za-z0-9-]+"))).alias("name")).distinct()
    return known.join(words, ["project", "name"], "left_anti").select(*finding("CA-D002", "WARN", "NEEDS_JUDGMENT", F.col("project"), F.concat(F.lit("skill never mentioned "), F.col("name"))))


def claims_of(targets: DataFrame) -> DataFrame:
    """Lines with a polarity and at least one subject."""
    lines = tx.exploded_lines(targets, ["project", "rel", "category"])
    # computed once a line; merged into the filters, the patterns would be searched again for each use
    rests = evaluated(lines.where(tx.may_point(F.col("line"))), {"rest": tx.without_negations(F.col("line"))})
    claims = evaluated(rests, {"polarity": tx.pointing(F.col("line"), F.col("rest"))}).drop("rest").where("polarity is not null")
    return evaluated(claims, {"subjects": tx.subjects_of(F.col("line"))}).where("size(subjects) > 0")


def claim_classes(claims: DataFrame) -> DataFrame:
    """Claims of a project with equal subjects and polarity are one class: ``cid``, how many they are and the first."""
    classes = claims.groupBy("project", "polarity", "subjects").agg(F.count("*").alias("members"), F.min(F.struct("rel", "line_no")).alias("first"))
    return cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))


def opposing_claims(classes: DataFrame, overlap: float = OVERLAP, most: int = 1_000_000) -> DataFrame:
    """Pairs of classes of opposite polarity within a project whose subjects overlap by ``overlap``.

    Copies are never paired with each other. Both sides of a project are cut into parts, and each part of one meets each
    of the other in a task of at most ``most`` pairs that counts what they share (``overlaps``), so only classes are
    shuffled and only pairs that overlap leave a task. Projects of few pairs are compared by a join.
    """
    ship(classes.sparkSession)
    side = lambda p: F.count_if(F.col("polarity") == p)
    held = classes.groupBy("project").agg(side("prohibit").alias("p"), side("allow").alias("q")).where("p > 0 and q > 0")
    both = classes.join(held, "project")
    a, b = (both.where(F.col("polarity") == p) for p in ("prohibit", "allow"))
    names = ["similarity", "prohibits", "prohibit_members", "allows", "allow_members"]

    few = F.col("p") * F.col("q") <= min(FEW, most)
    near = a.where(few).select("project", F.col("subjects").alias("sa"), F.col("first").alias("prohibits"), F.col("members").alias("prohibit_members")).join(
        b.where(few).select("project", F.col("subjects").alias("sb"), F.col("first").alias("allows"), F.col("members").alias("allow_members")), "project")
    near = evaluated(near, {"n": F.size(F.array_intersect("sa", "sb"))}).withColumn("similarity", F.col("n") / (F.size("sa") + F.size("sb") - F.col("n")))
    near = near.where((F.col("n") > 0) & (F.col("similarity") >= overlap)).select(names)

    # as many parts on each side as keep a part within the root of ``most``
    parts = lambda n: F.ceil(F.col(n) / F.lit(int(most**0.5))).cast("int")
    own = lambda n: F.array(F.pmod("cid", parts(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), parts(n) - 1)
    at = lambda rows, i, j: rows.where(~few).select("project", "polarity", "subjects", "first", "members", F.explode(i).alias("i"), j.alias("js")).select("*", F.explode("js").alias("j")).drop("js")
    tiles = at(a, own("p"), every("q")).unionByName(at(b, every("p"), own("q")))

    def run(tile: pa.Table) -> pa.Table:
        left, right = (tile.filter(pc.equal(tile["polarity"], p)).combine_chunks() for p in ("prohibit", "allow"))
        words = lambda side: pa.concat_arrays(side["subjects"].chunks) if side.num_rows else pa.array([], tile.schema.field("subjects").type)
        i, j, similarity = overlapping(words(left), words(right), overlap)
        return pa.Table.from_arrays([pa.array(similarity), left["first"].take(i), left["members"].take(i), right["first"].take(j), right["members"].take(j)], names=names)

    first, members = classes.schema["first"].dataType, classes.schema["members"].dataType
    far = tiles.groupBy("project", "i", "j").applyInArrow(run, StructType([StructField(n, t) for n, t in zip(names, (DoubleType(), first, members, first, members))]))
    return near.unionByName(far)


def _at(first: str):
    return F.concat_ws(":", F.col(first + ".rel"), F.col(first + ".line_no").cast("string"))


def rule_contradiction(targets: DataFrame, paths: DataFrame, shown: Callable = lambda text: text) -> DataFrame:
    """Each pair of classes once, at its first prohibition, with how many claims stand on both sides.

    ``shown`` masks the place that a pair is against once a class, not once a pair; no secret reaches beyond that place.
    """
    classes = claim_classes(claims_of(targets))
    pairs = opposing_claims(classes.withColumn("first", F.struct("first.*", shown(_at("first")).alias("shown"))))
    what = F.format_string("against %s (%d prohibit, %d allow)", "allows.shown", "prohibit_members", "allow_members")
    return pairs.select(*finding("CA-C001", "WARN", "REPORT_ONLY", _at("prohibits"), what))


def claim_members(claims: DataFrame) -> DataFrame:
    """Every claim with the first of its class, by which contradictions name the class: ``first, polarity, rel, line_no``."""
    first = claims.groupBy("project", "polarity", "subjects").agg(F.min(F.struct("rel", "line_no")).alias("first"))
    return claims.join(first, ["project", "polarity", "subjects"]).select(_at("first").alias("first"), "polarity", "rel", "line_no")


def front_entries(targets: DataFrame, keep: list[str]) -> DataFrame:
    """Top-level entries of a closed leading block: key, value, the line as written, position."""
    lines = tx.universal_lines(F.col("content"))
    end = F.array_position(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x)), F.lit("---"))
    rows = targets.where("content is not null").select(*keep, lines.alias("lines"), end.alias("end")).where("trim(lines[0]) = '---' and end > 0")
    entry = rows.select(*keep, F.posexplode(F.slice("lines", F.lit(2), F.col("end") - 1)).alias("pos", "raw"))
    pattern = r"^([A-Za-z_][A-Za-z0-9_-]*):(.*)$"
    return entry.where(F.col("raw").rlike(pattern)).select(*keep, (F.col("pos") + 2).alias("line_no"), F.regexp_extract("raw", pattern, 1).alias("key"), F.trim(F.regexp_extract("raw", pattern, 2)).alias("value"), "raw")


def front_fields(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One value per key, the last that stands."""
    return entries.groupBy(*keys, "key").agg(F.max_by("value", "line_no").alias("value"))


def rule_memory_shape(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """Missing entries, unknown types, entries not in canonical form."""
    entries = front_entries(targets.where("kind = 'memory'"), ["rel"])
    have = entries.groupBy("rel").agg(F.collect_set("key").alias("keys"))
    absent = have.select("rel", F.explode(F.array_except(F.array(*map(F.lit, MEMORY_KEYS)), "keys")).alias("key"), F.lit(1).alias("line_no"))
    first = entries.groupBy("rel", "raw", "key", "value").agg(F.min("line_no").alias("line_no"), F.count("*").alias("times"))
    strange = first.where((F.col("key") == "type") & (F.col("value") != "") & ~F.col("value").isin(*MEMORY_TYPES))
    canonical = F.when(F.col("value") == "", F.concat(F.col("key"), F.lit(":"))).otherwise(F.concat_ws(": ", "key", "value"))
    loose = first.where((F.col("raw") != canonical) & (F.rtrim("raw") != canonical))
    return (
        absent.select(*finding("CA-M001", "WARN", "NEEDS_JUDGMENT", _place(), F.concat(F.lit("no entry "), F.col("key"))))
        .unionByName(strange.select(*finding("CA-M001", "WARN", "NEEDS_JUDGMENT", _place(), F.lit("unknown type " + WITHHELD))))
        .unionByName(loose.select(*finding("CA-M001", "WARN", "AUTO_FIX", _place(), F.concat(F.lit("entry not canonical "), F.col("key")), F.col("raw"), canonical)))
    )


def rule_memory_path(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """A memory names a path that is not there."""
    lost = missing_references(path_references(targets.where("kind = 'memory'")), paths)
    return lost.select(*finding("CA-M101", "WARN", "NEEDS_JUDGMENT", _place(), F.lit("missing path " + WITHHELD)))


def rule_memory_secret(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """A memory's line with a credential (BLOCK) or personal data (WARN)."""
    lines = tx.exploded_lines(targets.where("kind = 'memory'"), ["rel"]).withColumn("kinds", tx.secret_kinds(F.col("line"))).where("size(kinds) > 0")
    grave = F.exists("kinds", lambda k: ~k.isin(*tx.PERSONAL_KINDS))
    return lines.select(*finding("CA-M301", F.when(grave, "BLOCK").otherwise("WARN"), "REPORT_ONLY", _place(), F.concat(F.lit("suspected "), F.array_join("kinds", ", "))))


CONTEXT_RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "CA-C001": rule_contradiction, "CA-D001": rule_runtime_tools, "CA-D002": rule_unmentioned_skill, "CA-M001": rule_memory_shape, "CA-M101": rule_memory_path,
    "CA-M301": rule_memory_secret, "CA-S001": rule_missing_path, "CA-S002": rule_missing_skill, "CA-U001": rule_unsafe,
}


def run_rules(targets: DataFrame, rules: dict[str, Callable] | None = None) -> DataFrame:
    """Findings of all rules, masked (E24); contradictions, which may be most of them, mask each class once."""
    paths = paths_of(targets)
    rules = rules or CONTEXT_RULES
    found = [masked_findings(rule(targets, paths)) for name, rule in sorted(rules.items()) if name != "CA-C001"]
    if "CA-C001" in rules:
        found.append(rules["CA-C001"](targets, paths, tx.mask_secrets))
    return reduce(DataFrame.unionByName, found)


def masked_findings(findings: DataFrame) -> DataFrame:
    """Every text that leaves is masked once, here; a fix keeps its place."""
    return findings.withColumns({c: tx.mask_secrets(F.col(c)) for c in ("what", "fix_old", "fix_new")})


# ------------------------------------------------------------------ interface audit (K)


def _fenced(docs: DataFrame, keep: list[str]) -> DataFrame:
    """K1: ``keep`` and ``outside``: the lines outside code fences as ``line_no, line``; any fence line toggles.

    Fence lines cut a text into stretches of which every other one lies outside, so each line is taken once, inside its row.
    """
    fence = r"^(?:`{3,}|~{3,})"
    rows = docs.where("content is not null").select(*keep, F.transform(tx.newline_lines(F.col("content")), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))).alias("lines"))
    rows = evaluated(rows, {"fences": F.transform(F.filter("lines", lambda x: F.trim(x["line"]).rlike(fence)), lambda x: x["line_no"])})
    rows = evaluated(rows, {"cuts": F.concat(F.array(F.lit(0)), "fences", F.array(F.size("lines") + 1))})
    cut = lambda k: F.element_at("cuts", k.cast("int"))
    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.size("fences") / 2)), lambda k: F.slice("lines", cut(2 * k + 1) + 1, cut(2 * k + 2) - cut(2 * k + 1) - 1))
    return rows.select(*keep, F.flatten(stretches).alias("outside"))


def lines_outside_fences(docs: DataFrame, keep: list[str]) -> DataFrame:
    """K1: lines outside code fences, one row each, numbering from 1."""
    return _fenced(docs, keep).select(*keep, F.inline("outside"))


def markdown_links(docs: DataFrame, keep: list[str]) -> DataFrame:
    """K2: links to ``.md`` outside fences, without anchors, and their labels."""
    rows = lines_outside_fences(docs, keep)
    pattern = r"(?:\[([^\[\]\n]*))?\]\(([^)\s#]+\.md[^)]*)\)"
    part = lambda i: F.regexp_extract_all("line", F.lit(pattern), F.lit(i))
    links = rows.where("contains(line, '](')").select(*keep, "line_no", F.inline(F.arrays_zip(part(1).alias("label"), part(2).alias("raw"))))
    return links.select(*keep, "line_no", "label", F.split("raw", "#")[0].alias("link")).where("link <> ''")


def resolved_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links of a project with the paths they lead to, as ``dst``: the path as written, else by label.

    A link whose path is not there but whose label is a skill of the project leads to that skill's first document in the
    directory that the link names. Links that lead nowhere are left out.
    """
    files = targets.where("path is not null")
    exact = links.join(files.select("project", F.col("path").alias("link")).distinct().withColumn("there", F.lit(True)), ["project", "link"], "left")
    home = files.where("skill_name is not null").groupBy("project", F.col("skill_name").alias("label"), tx.dir_name(F.col("path")).alias("dir")).agg(F.min("path").alias("dst"))
    by_label = exact.where("there is null").withColumn("dir", tx.dir_name(F.col("link"))).join(home, ["project", "label", "dir"])
    return exact.where("there").withColumn("dst", F.col("link")).drop("there").unionByName(by_label.drop("there", "dir"))


def rule_reference_depth(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """A first-level reference that links on, outside vendored contracts; each counted once."""
    links = markdown_links(targets.where("path is not null"), ["project", "rel", "path", "kind"])
    named = links.where((F.col("kind") == "skill_doc") & F.col("link").startswith("references/") & ~F.col("link").startswith("references/vendor/")).drop("path")
    first = resolved_links(named, targets).select("project", F.col("rel").alias("skill"), F.col("dst").alias("path")).distinct()
    onward = links.where("not startswith(link, 'vendor/')").select("project", "path", "line_no", "link")
    return first.join(onward, ["project", "path"]).select(*finding("SI-S001", "WARN", "REPORT_ONLY", F.concat_ws(":", "skill", "path", F.col("line_no").cast("string")), F.concat(F.lit("links on to "), F.col("link"))))


def rule_description(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """K4: a description that tells the procedure."""
    d = F.col("description")
    leaks = F.array_compact(F.array(F.when(d.rlike(r"(?i)Phase\s*\d|Step\s*\d"), "numbered phase"), F.when(d.rlike(r"\d+[.)]\s"), "numbered list"), F.when(d.rlike("まず.*次に|最初に.*その後"), "procedure words"), F.when(d.rlike("→.*→"), "arrow chain")))
    rows = targets.where("kind = 'skill_doc' and content is not null").select("rel", tx.description_of(F.col("content")).alias("description")).withColumn("leaks", leaks).where("size(leaks) > 0")
    return rows.select(*finding("SI-S002", "WARN", "REPORT_ONLY", F.col("rel"), F.array_join("leaks", ", ")))


def prose_share(targets: DataFrame) -> DataFrame:
    """Lines under prose headings against all lines of the body."""
    body = tx.without_front_matter(F.col("content"))
    lines = F.transform(tx.newline_lines(body), lambda x: F.trim(x))
    workflow = lambda x: F.lower(x).rlike("workflow|flow|phase|step|フロー|ワークフロー")
    folded = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("flow"), F.lit(0).alias("prose")),
        lambda acc, x: F.struct(
            F.when(x.startswith("## "), workflow(x)).otherwise(acc["flow"]).alias("flow"),
            (acc["prose"] + F.when(F.when(x.startswith("## "), workflow(x)).otherwise(acc["flow"]), 0).otherwise(1)).alias("prose"),
        ),
        lambda acc: acc["prose"],
    )
    return targets.where("kind = 'skill_doc' and content is not null").where(body.rlike(r"\S")).select("rel", folded.alias("prose"), F.size(lines).alias("lines"))


def rule_prose(targets: DataFrame, paths: DataFrame) -> DataFrame:
    rows = prose_share(targets).where(F.col("prose") / F.col("lines") > F.lit(PROSE_SHARE))
    return rows.select(*finding("SI-S003", "INFO", "REPORT_ONLY", F.col("rel"), F.format_string("prose %d of %d lines", "prose", "lines")))


def word_stream(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Words with their line, without front matter and fences; lines count from the body's first."""
    bodies = docs.withColumn("content", tx.without_front_matter(F.col("content")))
    words = lines_outside_fences(bodies, keep).select(*keep, "line_no", F.posexplode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0))).alias("at", "word"))
    return words


def shingles(docs: DataFrame, keep: list[str], n: int = NGRAM) -> DataFrame:
    """Each run of ``n`` words with the line and position where it begins; made inside the row."""
    bodies = docs.where("content is not null").withColumn("content", tx.without_front_matter(F.col("content")))
    spelled = lambda x: F.transform(F.regexp_extract_all(F.lower(x["line"]), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.struct(x["line_no"].alias("line_no"), w.alias("w")))
    words = evaluated(_fenced(bodies, keep), {"words": F.flatten(F.transform("outside", spelled))}).drop("outside")
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.struct(i.alias("pos"), F.element_at("words", i)["line_no"].alias("line_no"), F.array_join(F.transform(F.slice("words", i, F.lit(n)), lambda x: x["w"]), " ").alias("gram")))
    return words.where(F.size("words") >= n).select(*keep, F.inline(runs))


def first_shared_run(docs: DataFrame, contracts: DataFrame, keep: list[str], contract: str, n: int = NGRAM) -> DataFrame:
    """K7, K7c, K7d: per document and contract the first run of ``n`` words they share.

    Runs meet by equality; contract runs are made distinct first, so a run in many places
    joins each document's run once per contract.
    """
    ours = shingles(docs, keep, n)
    theirs = shingles(contracts, [contract], n).select(contract, "gram").distinct()
    return ours.join(theirs, "gram").groupBy(*keep, contract).agg(F.min_by("line_no", "pos").alias("line_no"), F.min_by("gram", "pos").alias("gram"))


def rule_copied_contract(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """K7e, K7: text shared with a contract of the same project that the document links to."""
    docs = targets.where("path is not null and content is not null")
    links = resolved_links(markdown_links(docs, ["project", "rel"]), docs).select("project", "rel", F.col("dst").alias("contract")).distinct()
    linked = docs.select("project", "rel", "content").join(links, ["project", "rel"])
    contracts = docs.select("project", F.col("path").alias("contract"), "content").join(links.select("project", "contract").distinct(), ["project", "contract"])
    ours = shingles(linked, ["project", "rel", "contract"])
    theirs = shingles(contracts.select(F.concat_ws("\u0001", "project", "contract").alias("both"), "content"), ["both"]).select("both", "gram").distinct()
    hit = ours.withColumn("both", F.concat_ws("\u0001", "project", "contract")).join(theirs, ["both", "gram"]).groupBy("rel", "contract").agg(F.min_by("line_no", "pos").alias("line_no"))
    return hit.select(*finding("SI-S006", "WARN", "NEEDS_JUDGMENT", _place(), F.concat(F.lit("shares text with "), F.col("contract"))))


INTERFACE_RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"SI-S001": rule_reference_depth, "SI-S002": rule_description, "SI-S003": rule_prose, "SI-S006": rule_copied_contract}


def assign_ids(findings: DataFrame) -> DataFrame:
    """K8: a rule that fires more than once gets a running number.

    Findings are put in ranges of their order; each range is numbered alone and begins after what the ranges
    before it hold, so no task has all findings of a rule.
    """
    order = ["place", "what", F.coalesce("fix_old", F.lit(""))]
    ranged = cut_lineage(findings.repartitionByRange("rule", *order).withColumn("stretch", F.spark_partition_id()))
    held = ranged.groupBy("rule", "stretch").agg(F.count("*").alias("n"))
    by_rule = Window.partitionBy("rule")
    held = held.select("rule", "stretch", F.coalesce(F.sum("n").over(by_rule.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by_rule).alias("all"))
    number = F.row_number().over(Window.partitionBy("rule", "stretch").orderBy(*order)) + F.col("before")
    numbered = ranged.join(held, ["rule", "stretch"]).withColumn("id", F.when(F.col("all") > 1, F.concat_ws("-", "rule", number.cast("string"))).otherwise(F.col("rule")))
    return numbered.drop("stretch", "before", "all")


# ------------------------------------------------------------------ findings (F)


def finding_id(rule="rule", place="place", what="what"):
    """sixteen hex digits; an absent part reads ``None``."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("None")) for c in (rule, place, what))), 256), 1, 16)


def severity_rank(column="severity"):
    return F.coalesce(F.element_at(F.create_map(*(x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v)))), F.col(column)), F.lit(UNKNOWN_RANK))


def findings_below(findings: DataFrame, severity: str) -> DataFrame:
    """strictly less grave."""
    return findings.where(severity_rank() > SEVERITY_RANK.get(severity, UNKNOWN_RANK))


def build_baseline(findings: DataFrame) -> DataFrame:
    """distinct ids, one row each (sorted where they are written)."""
    return findings.select(finding_id().alias("id")).distinct()


def apply_suppression(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """F16: findings whose id is not in the baseline."""
    return findings.withColumn("fid", finding_id()).join(baseline.select(F.col("id").alias("fid")), "fid", "left_anti")


def suppressed_count(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.withColumn("fid", finding_id()).join(baseline.select(F.col("id").alias("fid")).distinct(), "fid", "left_semi").agg(F.count("*").alias("withheld"))


def summarize(findings: DataFrame) -> DataFrame:
    """counts by action (three, zero-filled) and by severity (INFO where absent), from one pass over the findings."""
    counted = findings.groupBy("action", "severity").agg(F.count("*").alias("n"))
    facet = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    each = counted.select("n", F.inline(F.array(facet("action", F.col("action")), facet("severity", F.coalesce("severity", F.lit("INFO"))))))
    each = each.where((F.col("facet") == "severity") | F.col("value").isin(*ACTIONS))
    fixed = findings.sparkSession.createDataFrame([(0, "action", a) for a in ACTIONS], "n bigint, facet string, value string")
    return each.unionByName(fixed).groupBy("facet", "value").agg(F.sum("n").alias("n"))


def ranked(findings: DataFrame) -> DataFrame:
    """rank for the report's order: gravity, rule, place."""
    return findings.withColumn("gravity", severity_rank())


def withhold_fix(findings: DataFrame) -> DataFrame:
    """the body of a fix replaced by a constant."""
    return findings.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("(in the fix file)")) for c in ("fix_old", "fix_new")})


def apply_fixes(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Automatic fixes folded over each text in order of place; repeating it changes nothing.

    A reference is replaced inside ``](…)`` and code spans only; a front matter line where a whole line equals it.
    """
    fixes = findings.where("action = 'AUTO_FIX' and fix_old is not null").select(F.substring_index("place", ":", 1).alias("rel"), F.struct("place", "rule", "fix_old", "fix_new").alias("fix"))
    grouped = fixes.groupBy("rel").agg(F.array_sort(F.collect_list("fix")).alias("fixes"))
    one = lambda text, f: F.when(f["rule"] == "CA-S001", F.replace(F.replace(text, F.concat(F.lit("]("), f["fix_old"], F.lit(")")), F.concat(F.lit("]("), f["fix_new"], F.lit(")"))), F.concat(F.lit("`"), f["fix_old"], F.lit("`")), F.concat(F.lit("`"), f["fix_new"], F.lit("`")))).otherwise(
        F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(F.rtrim(x) == f["fix_old"], f["fix_new"]).when(x == f["fix_old"], f["fix_new"]).otherwise(x)), "\n")
    )
    return targets.join(grouped, "rel").select("rel", F.aggregate("fixes", F.col("content"), one).alias("fixed"))


def audit_targets(spark, sf_dir):
    """Documents and what was logged."""
    logged = log_targets(*(table(spark, sf_dir, t) for t in ("session_one", "oc_part", "oc_session")))
    return targets_of(table(spark, sf_dir, "documents")).unionByName(logged)


def rule_query(name: str):
    rule = CONTEXT_RULES.get(name) or INTERFACE_RULES[name]

    def query(spark, sf_dir):
        targets = audit_targets(spark, sf_dir)
        return rule(targets, paths_of(targets))

    return query


def all_findings(spark, sf_dir):
    """Findings of all context rules."""
    return run_rules(audit_targets(spark, sf_dir), CONTEXT_RULES)


def all_interface_findings(spark, sf_dir):
    """K9: findings of all interface rules, numbered."""
    return assign_ids(run_rules(audit_targets(spark, sf_dir), INTERFACE_RULES))
