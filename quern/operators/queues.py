"""Work queues of scenarios: prompts, units, manifest, contained paths and result records.

A queue is built from tables: what a runner would read from disk (skill texts, staged files) comes in as columns. Starting
processes and staging repositories are not data operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.batches import unit_id
from quern.operators.snapshots import latest_documents, normal_path
from quern.session import table

#: Fields of a result record, in order; defaults of a unit.
RECORD_FIELDS = ("id", "status", "error_kind", "failure_class", "exit_code", "duration_ms", "started_at")
STATUSES = ("done", "failed", "skipped")
ISOLATION, TIER = "worktree", "standard"


def section(title: str, body: Column) -> Column:
    """A titled part of a prompt; left out where the body is null."""
    return F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def prompt_of(skill="skill", skill_path="skill_path", skill_text="skill_text", work_dir="work_dir", output="output_file", env="env", situation="prompt", expectations="expectations", staged="staged") -> Column:
    """The prompt of one scenario.

    With ``skill_text`` the skill is inlined and its path left out. Expectations are numbered and do not say which are critical. An empty working
    directory is said to be empty; an empty or null ``env`` (a map) has no section.
    """
    told = F.when(F.col(skill_text).isNotNull(), F.concat(F.lit("The skill `"), F.col(skill), F.lit("` in full:\n\n<skill>\n"), F.rtrim(F.regexp_replace(skill_text, r"\n+\z", "")), F.lit("\n</skill>"))).otherwise(F.concat(F.lit("Read the skill `"), F.col(skill), F.lit("` and what it refers to: "), F.col(skill_path)))
    place = F.concat(F.col(work_dir), F.when(F.coalesce(F.col(staged), F.lit(0)) == 0, F.lit("\n\nIt is empty: what the situation tells of files is all there is.")).otherwise(""))
    pairs = F.array_sort(F.map_entries(F.coalesce(F.col(env), F.create_map().cast("map<string,string>"))))
    settings = F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("- `"), e["key"], F.lit("` = `"), e["value"], F.lit("`"))), "\n"))
    task = F.concat(F.lit("Follow the skill in this situation. Then write the report, as JSON, to "), F.col(output), F.lit(": for each item below its index, a verdict (yes, no, partial) and the evidence."))
    return F.concat_ws("\n", section("Skill", told), section("Working directory", place), section("Environment", settings), section("Situation", F.col(situation)), section("Task", task), section("Items", numbered(F.col(expectations))))


def build_queue(scenarios: DataFrame, batch: str, inline: bool = False) -> DataFrame:
    """One row per scenario: the unit of work, its prompt and its entry in the manifest; or a ``fault``.

    ``scenarios``: skill, scenario, title, isolation, executor_tier, prompt, expectations, env, staged, skill_text, scenario_sha. Faults in
    order: a malformed name, a skill without text, no prompt, no expectations, an identifier twice.
    """
    uid = unit_id(F.col("skill"), F.col("scenario"))
    rows = scenarios.withColumn("id", uid).withColumns(
        {"prompt_file": F.concat(F.lit("prompts/"), "id", F.lit(".md")), "cwd": F.concat(F.lit("work/"), "id"), "output_file": F.concat(F.lit("work/"), "id", F.lit("/report.json")), "skill_path": F.concat(F.lit("skills/"), "skill", F.lit("/SKILL.md")), "work_dir": F.concat(F.lit(batch + "/work/"), "id", F.lit("/staged")), "shown_output": F.concat(F.lit(batch + "/work/"), "id", F.lit("/report.json"))}
    )
    repeated = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("times")).where("times > 1")
    rows = rows.join(repeated, "id", "left")
    fault = (
        F.when(F.col("id").isNull(), "malformed name").when(F.col("skill_text").isNull(), "skill without text").when(F.coalesce(F.trim("prompt"), F.lit("")) == "", "no prompt")
        .when(F.coalesce(F.size("expectations"), F.lit(0)) <= 0, "no expectations").when(F.col("times") > 1, "identifier twice")
    )
    rows = rows.withColumn("fault", fault).withColumn("inlined", F.col("skill_text") if inline else F.lit(None).cast("string"))
    rendered = prompt_of(skill_text="inlined", output="shown_output")
    manifest = F.to_json(F.struct("skill", F.col("scenario").alias("scenario_id"), F.coalesce("title", "scenario").alias("title"), F.coalesce("isolation", F.lit(ISOLATION)).alias("isolation"), F.coalesce("executor_tier", F.lit(TIER)).alias("executor_tier"), "expectations", "scenario_sha", F.lit(inline).alias("inline_skill")))
    kept = lambda c: F.when(F.col("fault").isNull(), c)
    return rows.select("skill", "scenario", "id", "prompt_file", "output_file", "cwd", kept(rendered).alias("prompt_text"), kept(manifest).alias("manifest"), "fault")


def contained(path: Column, root: str) -> Column:
    """The absolute form of a path under ``root``; null if it leads out of it. An empty path is the root."""
    home = root.rstrip("/")
    whole = F.concat(F.lit("/"), normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(home + "/"), path))))
    return F.when((whole == home) | whole.startswith(home + "/"), whole)


def contained_paths(units: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Units with ``prompt_abs``, ``output_abs`` and ``cwd_abs``, or the first ``fault``; ``links`` are the symbolic links there are, as ``path``."""
    fields = ("prompt_file", "output_file", "cwd")
    rows = units.withColumns({f"abs_{f}": contained(F.coalesce(f, F.lit("")), root) for f in fields})
    known = links.select(F.col("path").alias("link")).distinct().withColumn("is_link", F.lit(True))
    for f in fields:
        rows = rows.join(known.withColumnsRenamed({"link": f"abs_{f}", "is_link": f"link_{f}"}), f"abs_{f}", "left")
    fault = F.coalesce(*(F.when(F.col(f"abs_{f}").isNull(), F.lit(f"{f} leads out of the root")).when(F.col(f"link_{f}"), F.lit(f"{f} is a link")) for f in fields))
    return rows.select(*units.columns, F.col("abs_prompt_file").alias("prompt_abs"), F.col("abs_output_file").alias("output_abs"), F.col("abs_cwd").alias("cwd_abs"), fault.alias("fault"))


def result_records(results: DataFrame) -> DataFrame:
    """I21g: one JSON record per result, of names and numbers only: empty kinds are null, and no other column leaves."""
    empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    fields = [empty(c) if c in ("error_kind", "failure_class") else F.col(c) for c in RECORD_FIELDS]
    return results.where(F.col("status").isin(*STATUSES)).select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def _scenarios(spark, sf_dir: str) -> DataFrame:
    """Scenario documents as scenarios: list items are what is expected; the skill's newest skill document is its text."""
    documents = table(spark, sf_dir, "documents")
    docs = latest_documents(documents.where("doc_kind = 'scenario' and skill_name is not null"))
    skill = documents.where("doc_kind = 'skill_doc' and skill_name is not null and text is not null").groupBy(F.col("skill_name").alias("skill")).agg(F.max_by("text", F.struct("updated_at", "doc_id")).alias("skill_text"))
    items = F.regexp_extract_all("content", F.lit(r"(?m)^- ([^\r\n]*)"), F.lit(1))
    name = F.regexp_replace(F.regexp_replace("path", r"^.*/|\.md$", ""), "[^a-z0-9-]", "-")
    none = F.lit(None).cast("string")
    rows = docs.select("skill", name.alias("scenario"), none.alias("title"), none.alias("isolation"), none.alias("executor_tier"), F.col("content").alias("prompt"), items.alias("expectations"), F.create_map(F.lit("LANG"), F.lit("C")).alias("env"), F.size(items).alias("staged"), F.sha2("content", 256).alias("scenario_sha"))
    return rows.join(skill, "skill", "left")


def i19_queue(spark, sf_dir: str) -> DataFrame:
    """The queue of all scenario documents, by hash of the prompt."""
    return build_queue(_scenarios(spark, sf_dir), "/batch").select("skill", "scenario", "id", "prompt_file", "output_file", "cwd", F.sha2("prompt_text", 256).alias("prompt_sha"), F.get_json_object("manifest", "$.title").alias("title"), "fault")


def i21_contained(spark, sf_dir: str) -> DataFrame:
    """Documents' paths, and what they link to beside them, held within the directory ``skills``."""
    units = table(spark, sf_dir, "documents").where("path is not null").select(F.col("doc_id").alias("id"), F.concat(F.lit("../"), "path").alias("prompt_file"), F.concat("skill_name", F.lit("/../report.json")).alias("output_file"), F.lit("").alias("cwd"))
    links = units.where("id % 5 = 0").select(F.concat(F.lit("/repo/"), F.col("prompt_file").substr(F.lit(4), F.length("prompt_file"))).alias("path"))
    return contained_paths(units, links, "/repo/skills").select("id", "prompt_abs", "output_abs", "cwd_abs", "fault")


def i21_records(spark, sf_dir: str) -> DataFrame:
    """Orders as results: an open one failed."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), F.when(status == "failed", "timeout").otherwise("").alias("error_kind"), F.when(status == "failed", "transient").otherwise("").alias("failure_class"),
        F.when(status == "done", 0).alias("exit_code"), F.col("o_custkey").cast("bigint").alias("duration_ms"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), "o_orderpriority",
    )
    return result_records(rows)


QUERIES = {"i19_queue": i19_queue, "i21_contained": i21_contained, "i21_records": i21_records}
_TEXT = """'## Skill' || chr(10) || chr(10) || 'Read the skill `' || skill || '` and what it refers to: skills/' || skill || '/SKILL.md' || chr(10) || chr(10)
  || '## Working directory' || chr(10) || chr(10) || '/batch/work/' || id || '/staged' || case when len(items) = 0 then chr(10) || chr(10) || 'It is empty: what the situation tells of files is all there is.' else '' end || chr(10) || chr(10)
  || '## Environment' || chr(10) || chr(10) || '- `LANG` = `C`' || chr(10) || chr(10) || '## Situation' || chr(10) || chr(10) || content || chr(10) || chr(10)
  || '## Task' || chr(10) || chr(10) || 'Follow the skill in this situation. Then write the report, as JSON, to /batch/work/' || id || '/report.json: for each item below its index, a verdict (yes, no, partial) and the evidence.' || chr(10) || chr(10)
  || '## Items' || chr(10) || chr(10) || array_to_string(list_transform(items, lambda x, i: i || '. ' || x), chr(10)) || chr(10)"""
ORACLES = {
    "i19_queue": rf"""
with d as (select path, arg_max(struct_pack(skill := skill_name, content := text), row(updated_at, doc_id)) as d from documents where doc_kind = 'scenario' and skill_name is not null and path is not null and text is not null group by path),
s as (select d.skill as skill, d.content as content, regexp_replace(regexp_replace(path, '^.*/|\.md$', '', 'g'), '[^a-z0-9-]', '-', 'g') as scenario, regexp_extract_all(d.content, '(?m)^- ([^\r\n]*)', 1) as items from d),
u as (select *, case when regexp_full_match(skill, '[a-z0-9][a-z0-9-]*') and regexp_full_match(scenario, '[a-z0-9][a-z0-9-]*') then skill || '-' || scenario end as id from s),
f as (select *, case when id is null then 'malformed name' when skill not in (select skill_name from documents where doc_kind = 'skill_doc' and skill_name is not null and text is not null) then 'skill without text' when trim(content) = '' then 'no prompt' when len(items) = 0 then 'no expectations' when count(*) over (partition by id) > 1 then 'identifier twice' end as fault from u)
select skill, scenario, id, 'prompts/' || id || '.md' as prompt_file, 'work/' || id || '/report.json' as output_file, 'work/' || id as cwd, case when fault is null then sha256({_TEXT}) end as prompt_sha, case when fault is null then scenario end as title, fault from f""",
    "i21_contained": """
select doc_id as id, case when starts_with(path, 'skills/') then '/repo/' || path end as prompt_abs, case when skill_name is null then '/repo/skills' else '/repo/skills/report.json' end as output_abs, '/repo/skills' as cwd_abs,
  case when not starts_with(path, 'skills/') then 'prompt_file leads out of the root' when exists (from documents o where o.doc_id % 5 = 0 and o.path = d.path) then 'prompt_file is a link' end as fault from documents d where path is not null""",
    "i21_records": """
select o_orderkey::varchar as id, '{"id":"' || o_orderkey || '","status":"' || case o_orderstatus when 'F' then 'done' when 'O' then 'failed' else 'skipped' end || '","error_kind":' || case o_orderstatus when 'O' then '"timeout"' else 'null' end || ',"failure_class":'
  || case o_orderstatus when 'O' then '"transient"' else 'null' end || ',"exit_code":' || case o_orderstatus when 'F' then '0' else 'null' end || ',"duration_ms":' || o_custkey || ',"started_at":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' as record from orders""",
}
