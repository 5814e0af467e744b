"""Operators that need a sequential grammar: Arrow batch functions around ``functions.grammars``."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import grammars as g
from quern.functions import text as tx
from quern.operators import rules
from quern.operators.snapshots import CUTOFF, cyclic_edges, latest_documents, linked_skills
from quern.session import arrow_safe, table

#: Keys and values that a scenario may declare.
SCENARIO_KEYS = ("skill", "id", "title", "source", "executor_tier", "isolation", "prompt", "expected_output", "expectations", "exercises", "files", "mtimes", "env", "git", "notes")
REQUIRED_KEYS = ("skill", "id", "prompt", "expectations")
TIERS, ISOLATIONS = ("standard", "high", "economy"), ("worktree", "none")
EXPECTATION_KEYS, GIT_KEYS = ("text", "critical", "assert"), ("init", "commit", "remote", "branch", "message", "commits")
HASH_LEAVES_OUT = ("exercises",)
CASE_FIELDS = ("id", "expected", "before", "after", "requirements")
WORK_FIELDS = ("id", "prompt_file", "output_file", "output_format", "cwd")


def _string_udf(function, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else function(x))

    return run


def structural_hash(content):
    """Structural hash of a text column."""
    return _string_udf(g.structural_fingerprint)(content)


def parse_declarations(docs: DataFrame) -> DataFrame:
    """``path, content`` -> ``path, declared`` (JSON) or ``error`` with its line."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, arrow_safe(json.dumps(g.load_block(content), ensure_ascii=False, sort_keys=True)), None))
                except g.BlockError as error:
                    rows.append((path, None, arrow_safe(str(error))))
            yield pd.DataFrame(rows, columns=["path", "declared", "error"])

    return docs.where("content is not null").select("path", "content").mapInPandas(run, "path string, declared string, error string")


def scenario_hashes(declared: DataFrame) -> DataFrame:
    """H5: hash of a declaration without what only says what it touches."""
    sha = _string_udf(lambda x: g.json_sha(json.loads(x), HASH_LEAVES_OUT))
    return declared.where("declared is not null").select("path", sha("declared").alias("sha"))


def scenario_violations(declared: DataFrame) -> DataFrame:
    """Every violation of a declaration, one row each; keys outside the list are violations too."""
    v = F.parse_json("declared")
    rows = declared.where("declared is not null").select("path", "declared", v.alias("v"))
    get = lambda c, p, t="string": F.try_variant_get(c, p, t)
    key = lambda k: get(F.col("v"), f"$.{k}")
    kind = lambda c: F.schema_of_variant(c)
    part = lambda k: get(F.col("v"), f"$.{k}", "variant")
    note = lambda condition, text: F.when(condition, text if not isinstance(text, str) else F.lit(text))
    files = F.transform(get(part("files"), "$", "array<variant>"), lambda x: F.struct(F.coalesce(get(x, "$.from"), get(x, "$")).alias("source"), F.when(kind(x).startswith("OBJECT"), get(x, "$.to")).otherwise(get(x, "$")).alias("to")))
    expectations = get(part("expectations"), "$", "array<variant>")
    unsafe = lambda p: p.rlike(r"^/|(^|/)\.\.(/|$)|(?i)(^|/)\.git(/|$)") | (F.trim(p) == "")
    destinations = F.transform(files, lambda f: f["to"])
    exercises = get(part("exercises"), "$", "array<string>")
    found = F.concat(
        F.transform(F.array_except(F.json_object_keys("declared"), F.array(*map(F.lit, SCENARIO_KEYS))), lambda k: F.concat(F.lit("unknown key "), k)),
        F.array_compact(F.array(*(note(F.coalesce(F.trim(key(k)), F.lit("")) == "", f"{k} is missing") for k in REQUIRED_KEYS))),
        F.array_compact(
            F.array(
                note(~F.coalesce(key("executor_tier"), F.lit(TIERS[0])).isin(*TIERS), "unknown tier"),
                note(~F.coalesce(key("isolation"), F.lit(ISOLATIONS[0])).isin(*ISOLATIONS), "unknown isolation"),
                note(F.exists(files, lambda f: f["source"].isNull() | f["to"].isNull()), "a file needs from and to"),
                note(F.exists(files, lambda f: unsafe(f["source"]) | unsafe(f["to"])), "unsafe path"),
                note(F.size(F.array_distinct(destinations)) < F.size(destinations), "a destination twice"),
                note(part("expectations").isNotNull() & ~F.coalesce(F.exists(expectations, lambda e: get(e, "$.critical", "boolean")), F.lit(False)), "no critical expectation"),
                note(F.exists(expectations, lambda e: F.coalesce(F.trim(get(e, "$.text")), F.lit("")) == ""), "an expectation needs text"),
                note(F.coalesce(kind(part("mtimes")), F.lit("OBJECT")).startswith("OBJECT") == F.lit(False), "mtimes must be a mapping"),
                note(F.exists(F.map_values(get(part("env"), "$", "map<string,variant>")), lambda x: kind(x) != "STRING"), "env must hold strings"),
                note(part("git").isNotNull() & ~F.coalesce(key("git.init") == "true", F.lit(False)) & (F.coalesce(part("git.commit"), part("git.remote"), part("git.branch"), part("git.message")).isNotNull()), "git needs init"),
                note(F.exists(exercises, lambda p: ~p.startswith("skills/") | unsafe(p)), "exercises must lie under skills/"),
            )
        ),
    )
    return rows.select("path", F.explode(found).alias("violation"))


def work_violations(lines: DataFrame) -> DataFrame:
    """``pos, line`` of a queue: unknown fields, ids and outputs that are missing, malformed or repeated."""
    v = F.try_parse_json("line")
    rows = lines.where(F.col("line").rlike(r"\S")).withColumn("v", v)
    get = lambda p: F.try_variant_get("v", p, "string")
    rows = rows.withColumns({"id": get("$.id"), "output": F.regexp_replace(F.regexp_replace(get("$.output_file"), r"(^|/)(\./)+", "$1"), "//+", "/"), "prompt": get("$.prompt_file"), "format": F.coalesce(get("$.output_format"), F.lit("text"))})
    repeated = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("pos").alias("first_" + c), F.count("*").alias("n_" + c)).where(f"n_{c} > 1").drop("n_" + c)
    rows = rows.join(repeated("id"), "id", "left").join(repeated("output"), "output", "left")
    unknown = F.array_except(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), F.array(*map(F.lit, WORK_FIELDS)))
    fault = (
        F.when(F.col("v").isNull(), "not json").when(F.size(unknown) > 0, "unknown field").when(~F.coalesce(F.col("id").rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False)), "invalid id").when(F.col("pos") > F.col("first_id"), "repeated id")
        .when(F.coalesce(F.col("prompt"), F.lit("")) == "", "no prompt_file").when(F.coalesce(F.col("output"), F.lit("")) == "", "no output_file").when(F.col("pos") > F.col("first_output"), "repeated output").when(~F.col("format").isin("text", "json"), "unknown format")
    )
    return rows.withColumn("fault", fault).where("fault is not null").select("pos", "fault")


def corpus_violations(cases: DataFrame) -> DataFrame:
    """``side, name, text``: why a calibration case is dropped; of repeated ids the first in order stands."""
    v = F.try_parse_json("text")
    rows = cases.withColumn("v", v)
    get = lambda p: F.try_variant_get("v", p, "string")
    missing = F.array_except(F.array(*map(F.lit, CASE_FIELDS)), F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")))
    wanted = F.replace(F.col("side"), F.lit("_"), F.lit("-"))
    requirements = F.try_variant_get("v", "$.requirements", "array<string>")
    fault = (
        F.when(F.col("v").isNull(), "not json").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(get("$.expected") != wanted, "expected contradicts the side")
        .when(F.coalesce(F.trim(get("$.id")), F.lit("")) == "", "no id").when(get("$.before") == get("$.after"), "nothing was edited").when(F.coalesce(F.size(requirements), F.lit(0)) <= 0, "no requirements")
    )
    rows = rows.withColumns({"fault": fault, "id": get("$.id")})
    first = rows.where("fault is null").groupBy("id").agg(F.min(F.struct("side", "name")).alias("first"))
    rows = rows.join(first, "id", "left").withColumn("fault", F.coalesce("fault", F.when(F.struct("side", "name") != F.col("first"), "repeated id")))
    return rows.where("fault is not null").select("side", "name", "fault")


def vocabulary_findings(targets: DataFrame) -> DataFrame:
    """K6: tool and model vocabulary outside fences, quotes and headings."""
    likely = "|".join(g.TOOLS) + "|claude-|gpt-|o1-"
    lines = rules.lines_outside_fences(targets, ["rel"]).where(F.col("line").rlike(f"(?i){likely}"))
    words = _string_udf(lambda x: g.tool_vocabulary(x), "array<string>")
    rows = lines.withColumn("words", words("line")).select("rel", "line_no", F.explode("words").alias("word"))
    return rows.select(*rules.finding("SI-S004", "WARN", "NEEDS_JUDGMENT", F.concat_ws(":", "rel", F.col("line_no").cast("string")), F.concat(F.lit("tied to "), F.col("word"))))


rules.INTERFACE_RULES["SI-S004"] = lambda targets, paths: vocabulary_findings(targets)


def headers(docs: DataFrame) -> DataFrame:
    """Name, description and how the header was read."""

    @F.pandas_udf("struct<name:string,description:string,observed:string>")
    def run(content: pd.Series, fallback: pd.Series) -> pd.DataFrame:
        rows = [g.skill_header(c, f or "") for c, f in zip(content, fallback)]
        return pd.DataFrame([(n and arrow_safe(n), d if d is None else arrow_safe(str(d)), o) for n, d, o in rows], columns=["name", "description", "observed"])

    return docs.select("rel", run("content", F.coalesce("skill_name", F.lit(""))).alias("h")).select("rel", "h.*")


def unified_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Text diff of changed paths; a side that is not there reads empty."""

    @F.pandas_udf("string")
    def run(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), f"a/{p}", f"b/{p}", lineterm="")) for p, x, y in zip(path, a, b)])

    both = before.select("path", F.col("content").alias("a")).join(after.select("path", F.col("content").alias("b")), "path", "full_outer").where("not (a <=> b)")
    return both.select("path", run("path", "a", "b").alias("diff"))


def walk_back_edges(edges: DataFrame) -> DataFrame:
    """Back edges of an ordered walk of each cycle component ``src, dst, component`` from its least node.

    Back edges lie on cycles only, so what is walked in one task is a component and not all documents of a skill.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(g.back_edges(list(zip(pdf["src"], pdf["dst"])), pdf["src"].min()), columns=["src", "dst"])

    return edges.groupBy("component").applyInPandas(run, "src string, dst string")


def _docs(spark, sf_dir):
    return rules.audit_targets(spark, sf_dir)


def a34_declarations(spark, sf_dir):
    """Front matter of skill documents, read as block YAML."""
    docs = _docs(spark, sf_dir).where("content is not null").select(F.col("rel").alias("path"), tx.front_matter(F.col("content")).alias("content")).where("content <> ''")
    return parse_declarations(docs)


def h05_scenario_hashes(spark, sf_dir):
    return scenario_hashes(a34_declarations(spark, sf_dir))


def h07_structural_hashes(spark, sf_dir):
    return latest_documents(table(spark, sf_dir, "documents")).select("path", structural_hash("content").alias("sha"))


def h33_diffs(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return unified_diffs(latest_documents(documents, CUTOFF), latest_documents(documents))


def i22_violations(spark, sf_dir):
    return scenario_violations(a34_declarations(spark, sf_dir))


def j01_headers(spark, sf_dir):
    return headers(_docs(spark, sf_dir))


def j08_back_edges(spark, sf_dir):
    return walk_back_edges(cyclic_edges(linked_skills(spark, sf_dir)))


def k06_vocabulary(spark, sf_dir):
    return vocabulary_findings(_docs(spark, sf_dir))


QUERIES = {n: globals()[n] for n in ("a34_declarations", "h05_scenario_hashes", "h07_structural_hashes", "h33_diffs", "i22_violations", "j01_headers", "j08_back_edges", "k06_vocabulary")}
ORACLES: dict[str, str] = {}
