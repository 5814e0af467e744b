"""Content hashes, snapshots and what must be verified again after a change (H, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.session import cut_lineage, table

#: Hash of a path that is not there, lightness of results, floor of calibration cases per side.
MISSING = "MISSING"
MIN_CASES = 20


def file_hashes(paths: DataFrame, contents: DataFrame) -> DataFrame:
    """Path -> sha256 of its bytes, or MISSING as a value like any other."""
    hashed = contents.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    return paths.join(hashed, "path", "left").withColumn("sha", F.coalesce("sha", F.lit(MISSING)))


def fingerprint(rows: DataFrame, by: str) -> DataFrame:
    """H6: one hash over ``path\\nhash\\n`` in order of path."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat(x["path"], F.lit("\n"), x["sha"], F.lit("\n")))
    return rows.groupBy(by).agg(F.sha2(F.array_join(parts, ""), 256).alias("fingerprint"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two snapshots ``keys, sha, structure``: same, added, removed, prose, change.

    A path that is added but missing is a change; without a structural hash on both sides a
    modified file counts as changed.
    """
    b = before.select(*keys, F.col("sha").alias("sha_before"), F.col("structure").alias("structure_before"))
    a = after.select(*keys, F.col("sha").alias("sha_after"), F.col("structure").alias("structure_after"))
    prose = F.coalesce(F.col("structure_before") == F.col("structure_after"), F.lit(False))
    kind = (
        F.when(F.col("sha_before").isNull(), F.when(F.col("sha_after") == MISSING, "change").otherwise("added"))
        .when(F.col("sha_after").isNull(), "removed")
        .when(F.col("sha_before") == F.col("sha_after"), "same")
        .when(prose & (F.col("sha_after") != MISSING) & (F.col("sha_before") != MISSING), "prose")
        .otherwise("change")
    )
    return b.join(a, keys, "full_outer").withColumn("kind", kind)


def stale_severity(diff: DataFrame, by: str) -> DataFrame:
    """H9: one severity per skill: none, addition, prose or change; anything uncertain is a change."""
    heavy = F.bool_or(F.col("kind").isin("change", "removed"))
    return diff.groupBy(by).agg(F.count_if(F.col("kind") != "same").alias("moved"), F.when(heavy, "change").when(F.bool_or(F.col("kind") == "prose"), "prose").when(F.bool_or(F.col("kind") == "added"), "addition").otherwise("none").alias("severity"))


def moved_fingerprint(diff: DataFrame, by: str) -> DataFrame:
    """Hash over the moved paths only, with both hashes."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha_before", "sha_after"))), lambda x: F.concat_ws("\n", x["path"], F.coalesce(x["sha_before"], F.lit("-")), F.coalesce(x["sha_after"], F.lit("-"))))
    return diff.where("kind <> 'same'").groupBy(by).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("moved_sha"))


def accept_result(severity, result):
    """A lighter label stands only on top of a pass."""
    return F.when(result != "pass", result).when(severity == "none", "pass").when(severity == "prose", "accepted-prose").when(severity == "addition", "accepted-addition").otherwise("stale")


def verification_state(surface: DataFrame, lock: DataFrame, by: str) -> DataFrame:
    """Unverified (no entry), orphan (entry without a skill), stale (moved) or verified."""
    now, then = fingerprint(surface, by).withColumnRenamed("fingerprint", "now"), lock.withColumnRenamed("fingerprint", "then")
    return now.join(then, by, "full_outer").select(by, F.when(F.col("then").isNull(), "unverified").when(F.col("now").isNull(), "orphan").when(F.col("now") != F.col("then"), "stale").otherwise("verified").alias("state"))


def coverage(skills: DataFrame, tracked: DataFrame, exempt: DataFrame) -> DataFrame:
    """Every skill is covered, exempt or uncovered."""
    df = skills.distinct().join(tracked.distinct().withColumn("t", F.lit(True)), "skill", "left").join(exempt.distinct().withColumn("e", F.lit(True)), "skill", "left")
    return df.select("skill", F.when(F.col("t"), "covered").when(F.col("e"), "exempt").otherwise("uncovered").alias("state"))


def declared_dependencies(scenarios: DataFrame, surface: DataFrame) -> DataFrame:
    """Declared paths of a scenario; null if none is declared or one is off the skill's surface."""
    own = surface.groupBy("skill").agg(F.collect_set("path").alias("surface"))
    df = scenarios.join(own, "skill", "left")
    ok = F.size(F.array_except("declared", F.coalesce("surface", F.array().cast("array<string>")))) == 0
    return df.withColumn("depends", F.when(F.col("declared").isNotNull() & (F.size("declared") > 0) & ok, F.col("declared"))).drop("surface")


def impacted_scenarios(scenarios: DataFrame, recorded: DataFrame, changed: DataFrame) -> DataFrame:
    """Why a scenario must run: changed text, new, undeclared dependencies, a changed dependency; else unaffected."""
    df = scenarios.join(recorded.select("skill", "scenario", F.col("scenario_sha").alias("was")), ["skill", "scenario"], "left")
    moved = changed.groupBy("skill").agg(F.collect_set("path").alias("moved"))
    df = df.join(moved, "skill", "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<string>")))
    return df.withColumn(
        "reason",
        F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("scenario_sha"), "scenario_changed").when(F.size("moved") == 0, "unaffected").when(F.col("depends").isNull(), "undeclared").when(F.arrays_overlap("depends", "moved"), "dependency_changed").otherwise("unaffected"),
    ).drop("was", "moved")


def carryover_reason(scenarios: DataFrame, hashes_then: DataFrame, hashes_now: DataFrame) -> DataFrame:
    """Why a result cannot be carried over: a dependency unbacked (no hash then) before one drifted; null if it can."""
    deps = scenarios.select("skill", "scenario", F.explode("depends").alias("path"))
    j = deps.join(hashes_then.select("path", F.col("sha").alias("then")), "path", "left").join(hashes_now.select("path", F.col("sha").alias("now")), "path", "left")
    per = j.groupBy("skill", "scenario").agg(F.array_sort(F.collect_set(F.when(F.col("then").isNull(), F.col("path")))).alias("unbacked"), F.array_sort(F.collect_set(F.when(F.col("then") != F.coalesce("now", F.lit(MISSING)), F.col("path")))).alias("drifted"))
    why = F.when(F.size("unbacked") > 0, F.concat(F.lit("unbacked: "), F.array_join("unbacked", ", "))).when(F.size("drifted") > 0, F.concat(F.lit("drifted: "), F.array_join("drifted", ", ")))
    return per.select("skill", "scenario", why.alias("reason"))


def partial_update(carry: DataFrame, ran: DataFrame, unaffected: DataFrame) -> DataFrame:
    """Ran -> pass, judged unaffected -> accepted-semantic, else carried or refused; one refusal refuses the whole skill."""
    df = carry.join(ran.withColumn("r", F.lit(True)), ["skill", "scenario"], "left").join(unaffected.withColumn("u", F.lit(True)), ["skill", "scenario"], "left")
    df = df.withColumn("result", F.when(F.col("r"), "pass").when(F.col("u"), "accepted-semantic").when(F.col("reason").isNull(), "carried").otherwise("refused"))
    return df.groupBy("skill").agg(
        F.bool_or(F.col("result") == "refused").alias("refused"), F.count_if(F.col("result") == "carried").alias("carried"), F.count_if(F.col("result") == "pass").alias("ran"), F.count("*").alias("scenarios")
    ).withColumn("outcome", F.when(F.col("refused"), "nothing written").when(F.col("ran") == F.col("scenarios"), "pass").when(F.col("carried") > 0, "carried").otherwise("accepted-semantic"))


def calibration(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Full outer join of expected sides and verdicts: outcome of each case."""
    df = cases.join(verdicts, "case_id", "full_outer")
    return df.withColumn(
        "outcome",
        F.when(F.col("expected").isNull(), "unknown_verdict").when(F.col("verdict").isNull(), "missing_verdict").when((F.col("expected") == "must-flag") & (F.col("verdict") == "pass"), "false_negative").when((F.col("expected") == "must-pass") & (F.col("verdict") == "flag"), "false_positive").otherwise("right"),
    )


def gate_reason(outcomes: DataFrame, floor: int = MIN_CASES) -> DataFrame:
    """The gate is closed on any error, any false negative, or too few cases on a side; null if open."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    per = outcomes.agg(n("unknown_verdict").alias("unknown"), n("missing_verdict").alias("missing"), n("false_negative").alias("false_negatives"), n("false_positive").alias("false_positives"), F.count_if(F.col("expected") == "must-flag").alias("must_flag"), F.count_if(F.col("expected") == "must-pass").alias("must_pass"))
    return per.withColumn("closed", F.when(F.col("unknown") + F.col("missing") > 0, "errors").when(F.col("false_negatives") > 0, "false negatives").when(F.least("must_flag", "must_pass") < floor, "too few cases"))


# ------------------------------------------------------------------ graphs


LINK = r"(?:\[([^\[\]\n]*))?\]\(([^)\s]+)\)"


def labelled_links(docs: DataFrame) -> DataFrame:
    """H2, H3: relative ``.md`` links without anchors, placeholders or names that open with a time, and their labels."""
    part = lambda i: F.regexp_extract_all("content", F.lit(LINK), F.lit(i))
    pairs = F.transform(F.arrays_zip(part(1).alias("label"), part(2).alias("raw")), lambda x: F.struct(x["label"].alias("label"), F.split(x["raw"], "#")[0].alias("link")))
    rows = docs.where("contains(content, '](')").select("path", F.inline(F.array_distinct(pairs)))
    return rows.where(F.col("link").endswith(".md") & ~F.col("link").rlike(r"^(?:https?://|mailto:|#|/)|[{*]") & ~tx.base_name(F.col("link")).rlike(r"^\d{8,}"))


def checkable_links(docs: DataFrame) -> DataFrame:
    return labelled_links(docs).select("path", "link").distinct()


def normal_path(path):
    """A path without empty, ``.`` and ``..`` steps; ``..`` above the root stays."""

    def step(acc, x):
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != "..")
        return F.when(x.isin("", "."), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def beside(path, link):
    """``link`` as seen from the directory of ``path``."""
    return normal_path(F.when(tx.dir_name(path) == "", link).otherwise(F.concat_ws("/", tx.dir_name(path), link)))


def _existing(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(docs.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").where("src <> dst")


def link_edges(docs: DataFrame) -> DataFrame:
    """H1: edges ``src, dst`` of links to existing paths of ``path, skill, content``.

    A link is tried as written from the root and from the file's own directory. One that leads to neither and
    whose label is a skill leads to that skill's first document, by path, in the directory it names.
    """
    links = labelled_links(docs)
    tried = links.select(F.col("path").alias("src"), "label", "link", F.explode(F.array_distinct(F.array(normal_path(F.col("link")), beside(F.col("path"), F.col("link"))))).alias("dst"))
    exact = _existing(tried, docs)
    home = docs.where("skill is not null").groupBy(F.col("skill").alias("label"), tx.dir_name(F.col("path")).alias("dir")).agg(F.min("path").alias("dst"))
    lost = links.withColumnRenamed("path", "src").join(exact.select("src", "link").distinct(), ["src", "link"], "left_anti").withColumn("dir", tx.dir_name(F.col("link")))
    by_label = lost.join(home, ["label", "dir"]).where("src <> dst")
    return exact.select("src", "dst").unionByName(by_label.select("src", "dst")).distinct()


def bare_path_edges(docs: DataFrame) -> DataFrame:
    """Files under ``skills/`` that a Markdown text names as a bare path, from the root or its own directory; no tests."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_./-]+\.(?:md|py|sh)"), F.lit(0)))
    rows = docs.where("endswith(path, '.md')").select(F.col("path").alias("src"), F.explode(names).alias("name")).where(~tx.base_name(F.col("name")).rlike(r"^test_.*\.py$"))
    tried = rows.select("src", F.explode(F.array_distinct(F.array(normal_path(F.col("name")), beside(F.col("src"), F.col("name"))))).alias("dst")).where("startswith(dst, 'skills/')")
    return _existing(tried, docs).select("src", "dst").distinct()


SHARED = "skills/shared/scripts/"


def import_edges(docs: DataFrame) -> DataFrame:
    """A skill's scripts to the shared modules they import, by name, one hop; tests neither import nor are imported."""
    test = tx.base_name(F.col("path")).startswith("test_")
    modules = docs.where(F.col("path").rlike("^" + SHARED + r"[^/]+\.py$") & ~test).select(F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("module"), F.col("path").alias("dst")).distinct()
    lines = docs.where(F.col("path").endswith(".py") & ~test & ~F.col("path").startswith(SHARED)).select(F.col("path").alias("src"), F.explode(F.split("content", "\n")).alias("line"))
    named = lines.select("src", F.regexp_extract("line", r"^\s*(?:import|from)\s+([A-Za-z_][A-Za-z0-9_]*)", 1).alias("module")).where("module <> ''").distinct()
    return named.join(modules, "module").select("src", "dst").where("src <> dst")


def surface_edges(docs: DataFrame) -> DataFrame:
    """Everything by which one file depends on another in one hop."""
    return link_edges(docs).unionByName(bare_path_edges(docs)).unionByName(import_edges(docs)).distinct()


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from each start with their least depth, by frontiers.

    Each round joins only the frontier and drops what is reached already; rounds end when the
    frontier is empty, or at ``max_depth`` if the caller asks for one. Lineage is cut every round.
    What is reached is kept in runs that are merged with later ones as large, so that a deep graph
    does not write all of it again in every round.
    """
    # a generated row leaves constraints behind; those that a checkpoint keeps name columns a union does not know
    def cut(df: DataFrame) -> DataFrame:
        return cut_lineage(df.select(F.inline(F.array(F.struct("start", "node", "depth")))))

    frontier = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    runs, size, depth = [], frontier.count(), 0
    while size:
        merged = frontier
        while runs and runs[-1][0] <= size:
            n, run = runs.pop()
            size, merged = size + n, merged.unionByName(run)
        runs.append((size, merged if merged is frontier else cut(merged)))
        if depth == max_depth:
            break
        depth += 1
        reached = reduce(DataFrame.unionByName, (run for _, run in runs))
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct().join(reached, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(step)
        size = frontier.count()
    return reduce(DataFrame.unionByName, (run for _, run in runs)) if runs else frontier


def skill_edges(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges between documents lifted to the skills that hold them."""
    of = lambda end: docs.where("skill is not null").select(F.col("path").alias(end), F.col("skill").alias("of_" + end))
    return edges.join(of("src"), "src").join(of("dst"), "dst").where("of_src <> of_dst").select(F.col("of_src").alias("src"), F.col("of_dst").alias("dst")).distinct()


def _ends_meet(edges: DataFrame) -> DataFrame:
    """Edges left once those that begin where none ends, or end where none begins, are gone, again and again."""
    while True:
        kept = cut_lineage(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if kept.count() == edges.count():
            return kept
        edges = kept


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node: ``node, component``.

    Each round trims what lies on no cycle, gives every node the greatest name that reaches it, and follows the
    edges back from the nodes that kept their own name: what is met under the same name is a component. Work follows the
    edges, never pairs of nodes.
    """
    rest, found = cut_lineage(edges.where("src <> dst").select("src", "dst").distinct()), None
    while not (rest := _ends_meet(rest)).isEmpty():
        colour = cut_lineage(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            into = rest.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("seen"))
            after = cut_lineage(colour.join(into, "node", "left").select("node", F.greatest("colour", F.coalesce("seen", "colour")).alias("colour"), (F.col("seen") > F.col("colour")).alias("changed")))
            colour = after.select("node", "colour")
            if after.where("changed").isEmpty():
                break
        # edges inside a colour, turned round; each colour's root is the node of that name
        back = cut_lineage(rest.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select(F.col("dst").alias("from"), F.col("src").alias("node"), F.col("a").alias("component")))
        met = cut_lineage(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        frontier = met
        while not frontier.isEmpty():
            step = back.join(frontier.select(F.col("node").alias("from"), "component"), ["from", "component"]).select("node", "component").distinct()
            frontier = cut_lineage(step.join(met, ["node", "component"], "left_anti"))
            met = cut_lineage(met.unionByName(frontier))
        found = met if found is None else found.unionByName(met)
        inside = met.select("node")
        rest = cut_lineage(rest.join(inside.withColumnRenamed("node", "src"), "src", "left_anti").join(inside.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    # a node alone in its colour lies on no cycle
    return found.join(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select("node", "component")


def cyclic_edges(edges: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """J8, as a relation: edges on a cycle, with their component. A superset of the back edges of one walk."""
    held = components(edges) if held is None else held
    return edges.join(held.withColumnRenamed("node", "src"), "src").join(held.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select("src", "dst", "component")


def unresolved_references(docs: DataFrame) -> DataFrame:
    """Why a reference leads nowhere: dynamic, unsupported, containment, missing."""
    links = F.regexp_extract_all("content", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    rows = docs.select("path", F.explode(F.array_distinct(links)).alias("raw")).withColumn("link", F.split("raw", "#")[0]).where("link <> ''")
    rows = rows.withColumn("target", F.when(tx.dir_name(F.col("path")) == "", F.col("link")).otherwise(F.concat_ws("/", tx.dir_name(F.col("path")), F.col("link"))))
    known = docs.select(F.col("path").alias("p")).distinct()
    rows = rows.join(known.withColumn("at_root", F.lit(True)), F.col("link") == F.col("p"), "left").drop("p").join(known.withColumn("at_own", F.lit(True)), F.col("target") == F.col("p"), "left").drop("p")
    kind = F.when(F.col("link").rlike(r"[{}<>*$]"), "dynamic").when(F.col("link").rlike(r"^[a-z]+:"), "unsupported").when(F.col("link").rlike(r"^/|(^|/)\.\./"), "containment").when(F.col("at_root") & F.col("at_own") & (F.col("link") != F.col("target")), "ambiguous").when(F.col("at_root").isNull() & F.col("at_own").isNull(), "missing")
    return rows.withColumn("kind", kind).where("kind is not null").select("path", "raw", "kind")


def behavior_surface(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Per skill its own files without tests, and what they link to in one hop."""
    own = docs.where(F.col("skill").isNotNull() & ~tx.base_name(F.col("path")).rlike(r"^test_.*\.py$|\.pyc$")).select("skill", "path").distinct()
    return own.unionByName(own.join(edges, F.col("path") == F.col("src")).select("skill", F.col("dst").alias("path"))).distinct()


def impacted_skills(surface: DataFrame, changed: DataFrame) -> DataFrame:
    """Skills with a changed path on their surface."""
    return surface.join(changed, "path", "left_semi").groupBy("skill").agg(F.count("*").alias("paths"))


def normalize_path(path, root: str):
    """A path relative to ``root``; null outside it or for the root itself."""
    bare = F.regexp_replace(path, r"/\./|//+", "/")
    inner = F.when(bare.startswith("/"), F.when(bare.startswith(root.rstrip("/") + "/"), F.substring(bare, len(root.rstrip("/")) + 2, 100_000))).otherwise(F.regexp_replace(bare, r"^\./", ""))
    return F.when(~inner.rlike(r"(^|/)\.\.(/|$)"), F.nullif(inner, F.lit("")))


def latest_documents(documents: DataFrame, until: str | None = None) -> DataFrame:
    """The newest text of each path, as of a time."""
    rows = documents.where("path is not null and text is not null")
    if until:
        rows = rows.where(F.col("updated_at") <= F.lit(until).cast("timestamp_ntz"))
    return rows.groupBy("path").agg(F.max_by(F.struct(F.col("skill_name").alias("skill"), F.col("text").alias("content")), F.struct("updated_at", "doc_id")).alias("d")).select("path", "d.skill", "d.content")


CUTOFF = "2026-06-01 00:00:00"


def _snap(docs: DataFrame) -> DataFrame:
    """Snapshot of documents; the structure of a text is hashed from its lines that are not running text."""
    lines = F.filter(F.split("content", "\n", -1), lambda x: x.rlike(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:\s|$)|^\s*[#>|]|[`\[|*_~]|^ {4}|^\t"))
    return docs.where("skill is not null").select("skill", "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("structure"))


def _two(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return _snap(latest_documents(documents, CUTOFF)), _snap(latest_documents(documents))


def h06_fingerprints(spark, sf_dir):
    return fingerprint(_two(spark, sf_dir)[1], "skill")


def h09_snapshot_diff(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    return snapshot_diff(before, after, ["skill", "path"]).select("skill", "path", "kind")


def h09_severity(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    return stale_severity(snapshot_diff(before, after, ["skill", "path"]), "skill")


def h18_moved(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    return moved_fingerprint(snapshot_diff(before, after, ["skill", "path"]), "skill")


def h23_states(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    return verification_state(after, fingerprint(before, "skill"), "skill")


def h24_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("skill_name is not null")
    pick = lambda kind: d.where(F.col("doc_kind") == kind).select(F.col("skill_name").alias("skill"))
    return coverage(d.select(F.col("skill_name").alias("skill")), pick("scenario").where("contains(skill, 'a')"), pick("prompt"))


def h13_impact(spark, sf_dir):
    """Scenario documents of a skill: which must run again after the later snapshot."""
    before, after = _two(spark, sf_dir)
    changed = snapshot_diff(before, after, ["skill", "path"]).where("kind in ('change', 'prose', 'removed')").select("skill", "path")
    named = lambda docs: docs.select("skill", F.col("path").alias("scenario"), F.col("sha").alias("scenario_sha"), F.when(F.col("sha") < "8", F.array("path")).alias("declared"))
    scenarios = declared_dependencies(named(after), after.select("skill", "path"))
    return impacted_scenarios(scenarios, named(before), changed).select("skill", "scenario", "reason")


def h15_carryover(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    scenarios = after.select("skill", F.col("path").alias("scenario"), F.array("path").alias("depends"))
    return carryover_reason(scenarios, before.select("path", "sha"), after.select("path", "sha"))


def h26_partial_update(spark, sf_dir):
    carry = h15_carryover(spark, sf_dir)
    named = carry.select("skill", "scenario")
    return partial_update(carry, named.where("contains(scenario, 'docs/')"), named.where("contains(scenario, 'evals/')"))


def h30_calibration(spark, sf_dir):
    """Graded documents as cases, the first judgment of their level as verdict."""
    docs, graded = table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_level_sample")
    cases = graded.select(F.col("doc_id").alias("case_id"), F.when(F.col("level") >= 3, "must-flag").otherwise("must-pass").alias("expected"))
    verdicts = docs.where("text is not null and doc_id % 3 <> 1").select(F.col("doc_id").alias("case_id"), F.when(F.length("text") > 1200, "flag").otherwise("pass").alias("verdict"))
    return calibration(cases, verdicts).groupBy("outcome").agg(F.count("*").alias("n"))


def h31_gate(spark, sf_dir):
    docs, graded = table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_level_sample")
    cases = graded.select(F.col("doc_id").alias("case_id"), F.when(F.col("level") >= 3, "must-flag").otherwise("must-pass").alias("expected"))
    verdicts = docs.join(graded.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("case_id"), F.when(F.length("text") > 1200, "flag").otherwise("pass").alias("verdict"))
    return gate_reason(calibration(cases, verdicts))


def _graph(spark, sf_dir):
    return latest_documents(table(spark, sf_dir, "documents"))


def h01_closure(spark, sf_dir):
    """What every document leads to by links, with the least number of them."""
    docs = _graph(spark, sf_dir)
    return closure(cut_lineage(link_edges(docs)), docs.select(F.col("path").alias("start")))


def h01_edges(spark, sf_dir):
    return link_edges(_graph(spark, sf_dir))


def h02_links(spark, sf_dir):
    return checkable_links(_graph(spark, sf_dir))


def j07_unresolved(spark, sf_dir):
    return unresolved_references(_graph(spark, sf_dir))


def linked_skills(spark, sf_dir):
    docs = _graph(spark, sf_dir)
    return cut_lineage(skill_edges(link_edges(docs), docs))


def j08_cycles(spark, sf_dir):
    """Skills whose documents refer to each other in a circle, and by which references."""
    return cyclic_edges(linked_skills(spark, sf_dir)).select("src", "dst")


def j13_surface(spark, sf_dir):
    docs = _graph(spark, sf_dir)
    return behavior_surface(docs, surface_edges(docs))


def j15_impacted(spark, sf_dir):
    docs = _graph(spark, sf_dir)
    before, after = _two(spark, sf_dir)
    changed = snapshot_diff(before, after, ["skill", "path"]).where("kind <> 'same'").select("path")
    return impacted_skills(behavior_surface(docs, surface_edges(docs)), changed)
