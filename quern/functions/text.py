"""Column expressions over document text: lines, paths, tokens, polarity, secrets.

Two families of line splitting exist side by side: ``universal_lines`` ends a line at every
Unicode line end and has no line after a final end; ``newline_lines`` splits at ``\\n`` alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"

#: Words of English left out of lexical similarity.
STOP_WORDS = (
    "an and any are as at be been but by can do does for from had has have if in into is it its "
    "no not of on one only or other over so than that the their them then there these they this "
    "those through to up was were what when where which while who why will with would you your "
    "say saying says use used user users uses"
).split()
#: Words that say which way a claim points.
POLARITY_WORDS = "する しない してよい するな こと must not should never avoid always don allowed".split()
#: Patterns of negation, prohibition and permission.
NEGATION = r"(?i)\b(?:must|should|shall|may|can|will)\s+not\b|\b(?:must|should|do|does|did)n['’]t\b|\b(?:ca|sha|wo)n['’]t\b|\bcannot\b|\bnot\s+(?:allowed|permitted)\b"
PROHIBIT = r"(?i)するな|しない(?:こと)?|禁止|してはならない|べきでない|never\b|don't\b|do not\b|avoid\b"
ALLOW = r"(?i)してよい|してもよい|許可|するべき|すること(?:$|。)|always\b|must\b|should\b|allowed\b"
#: Words of which each match of these patterns holds one, and those beyond ASCII.
POINTERS = ("not", "n't", "never", "avoid", "always", "must", "should", "allowed")
POINTERS_CJK = ("n’t", "する", "しない", "禁止", "して", "べき", "許可")
#: Wording that permits skipping a confirmation or destroying something, in order.
UNSAFE = (
    ("skipped confirmation", r"確認(?:なし|せず|を省略|不要|を飛ば)"),
    ("destructive operation", r"rm\s+-rf|--force\b|--no-verify\b|force\s*push|強制(?:削除|プッシュ|的に削除)"),
    ("unconditional permission", r"(?i)無条件で|without confirmation|skip confirmation|auto-?approve|bypass(?:ing)?\s+permission"),
)
#: Tool names of one runtime.
RUNTIME_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "TodoWrite")
CJK_RUN = r"[぀-ヿ一-鿿]+"

#: Patterns of secrets and personal data, masked in this order (design of this project).
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("prefix_token", r"\b(?:ghp|gho|ghs|github_pat|xoxb|xoxp|glpat|sk|pk)[_-][A-Za-z0-9_-]{16,}"),
    ("generic_secret", r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\b\s*[:=]\s*[\"']?[^\s\"']{8,}"),
    ("email", r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    ("home_path", r"(?:/home|/Users)/[A-Za-z0-9._-]+"),
    ("generic_long_key", r"\b[A-Fa-f0-9]{40,}\b"),
)
PERSONAL_KINDS = ("email", "home_path")


def universal_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS, -1)


def newline_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def exploded_lines(docs: DataFrame, keep: list[str], universal: bool = True) -> DataFrame:
    """``keep`` plus ``line_no`` from 1 and ``line``; an empty text has no lines in the universal family."""
    lines = universal_lines(F.col("content")) if universal else newline_lines(F.col("content"))
    rows = docs.where("content is not null").select(*keep, F.posexplode(lines).alias("pos", "line"))
    return rows.select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def cjk_bigrams(text: Column) -> Column:
    runs = F.filter(F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0)), lambda r: F.length(r) >= 2)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def lexical_tokens(text: Column) -> Column:
    """Sorted set of ASCII words of two characters or more without stop words, and bigrams of CJK runs."""
    low = F.lower(text)
    words = F.array_except(F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))
    return F.array_sort(F.array_union(words, cjk_bigrams(low)))


def subjects_of(line: Column) -> Column:
    """What a line is about; no stop words, but words of polarity are left out."""
    words = F.array_union(F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]{2,}"), F.lit(0)), cjk_bigrams(line))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, POLARITY_WORDS))))


def without_negations(line: Column) -> Column:
    return F.regexp_replace(line, NEGATION, " ")


def pointing(line: Column, rest: Column) -> Column:
    """E12 of a line and what is left of it without negations, which differs from it if it has one; each pattern is searched once."""
    ways = ((rest != line) | rest.rlike(PROHIBIT)).cast("int") - rest.rlike(ALLOW).cast("int")
    return F.element_at(F.array(F.lit("allow"), F.lit(None).cast("string"), F.lit("prohibit")), ways + 2)


def polarity_of(line: Column) -> Column:
    """Prohibit or allow; null if a line points both ways or neither. Negations are taken out first."""
    return pointing(line, without_negations(line))


def may_point(line: Column) -> Column:
    """Holds one of the words without which no pattern of E12 matches."""
    low = F.lower(line)
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return has(POINTERS) | ((F.length(line) < F.octet_length(line)) & has(POINTERS_CJK))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets give 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def is_pathish(ref: Column) -> Column:
    """Reads as a path whose existence can be checked."""
    base = base_name(ref)
    return ref.rlike(r"^[A-Za-z0-9_./-]+$") & ~ref.rlike(r"^(?:https?://|mailto:|#|/)") & ref.contains("/") & ~base.rlike(r"^\d{8,}") & (base.rlike(r"\.[A-Za-z0-9]+$") | ref.endswith("/"))


def secret_kinds(text: Column) -> Column:
    """Kinds found in a text, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), kind) for kind, p in SECRETS))))


def mask_secrets(text: Column) -> Column:
    """Each secret replaced by ``[REDACTED:kind]``."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def shown_location(path: Column) -> Column:
    """A location as a report may show it: masked like every text that leaves."""
    return mask_secrets(path)


def mask_project_key(key: Column) -> Column:
    """The home part of a path or of a hyphenated project key masked."""
    return F.regexp_replace(F.regexp_replace(key, r"^-(?:home|Users)-[^-/]+", "-[REDACTED:home_path]"), r"(?:/home|/Users)/[^/]+", "[REDACTED:home_path]")


def project_slug(path: Column) -> Column:
    """Everything but letters, digits and hyphens becomes a hyphen."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")


def slash_skill(text: Column) -> Column:
    """The skill of the first ``/plugin:skill`` in a text; null without one."""
    return F.nullif(F.regexp_extract(text, r"/([a-z][a-z0-9-]*):([a-z][a-z0-9-]*)", 2), F.lit(""))


def bare_name(name: Column) -> Column:
    """Trimmed, without one ``plugin:`` prefix."""
    return F.regexp_replace(F.trim(name), r"^[a-z][a-z0-9-]*:", "")


def high_entropy(text: Column) -> Column:
    """Holds a run of twenty or more key characters with a digit, an upper and a lower letter."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/=_-]{20,}"), F.lit(0))
    return F.exists(runs, lambda r: r.rlike("[0-9]") & r.rlike("[A-Z]") & r.rlike("[a-z]"))


def approx_tokens(size: Column) -> Column:
    """A token for four bytes begun, one at least."""
    return F.greatest(F.lit(1), F.ceil(size / 4))


def front_matter(text: Column) -> Column:
    """Body of a leading ``---`` block; '' without one."""
    return F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)


def without_front_matter(text: Column) -> Column:
    """K10."""
    return F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def description_of(text: Column) -> Column:
    """One-line description of the front matter; '' without one."""
    return F.trim(F.regexp_extract(front_matter(text), r"(?m)^description:(.*)$", 1))
