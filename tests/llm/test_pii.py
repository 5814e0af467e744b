"""Personal information: generated held-out texts, hand-made cases, decoding against all labellings."""

import itertools
import random
import re
from collections import Counter

import pii_phrases
import pytest

from quern.llm import pii
from quern.llm import pii_model
from quern.llm.pii_model import Gazetteer, candidates, decode, make_example, train


@pytest.fixture(scope="module")
def model(duck):
    names = tuple(duck.execute("select person_name, name_kind from name_list order by 1, 2").fetchall())
    return names, Gazetteer(list(names)), dict(train(names))


def kinds(model, text):
    _, gazetteer, weights = model
    return {k for *_, k in decode(candidates(text, gazetteer), weights)}


def test_held_out_examples(model):
    names, gazetteer, weights = model
    rng, right, found, wanted = random.Random(99), 0, 0, 0
    for _ in range(1500):
        text, gold = make_example(rng, list(names), [n for n, _ in names if gazetteer.token_class(n) == "a"])
        got = set(decode(candidates(text, gazetteer), weights))
        right, found, wanted = right + len(got & gold), found + len(got), wanted + len(gold)
    assert right / found > 0.96 and right / wanted > 0.96


def test_phrasing_never_trained_on(model):
    names, wanted, found, wrong = model[0], Counter(), Counter(), 0
    for text, kind in pii_phrases.examples(list(names)):
        got = kinds(model, text)
        wanted[kind] += 1
        found[kind] += kind in got
        wrong += len(got - {kind})
    assert wanted.total() >= 200 and all(found[k] / wanted[k] >= 0.9 for k in wanted), (wanted, found)
    assert wrong <= 0.02 * wanted.total() and sum(bool(kinds(model, d)) for d in pii_phrases.DECOYS) <= 2


def test_sentences_are_not_those_of_the_tables(duck):
    """No run of three words of a training sentence stands in what is said in the tables."""
    said = "\n".join(t for (t,) in duck.execute("select message.content from session_one where message.content is not null union all select payload from rollout where payload is not null").fetchall()).lower()
    made = [*pii_model._FILL, *(x for group in (pii_model._BEFORE, pii_model._AFTER) for many in group.values() for x in many)]
    runs = {" ".join(w[i : i + 3]) for p in made for part in re.split(r"\{.\}", p.lower()) for w in [part.split()] for i in range(len(w) - 2)}
    assert len(runs) > 100 and not [r for r in runs if r in said]


CASES = {
    "send it to a.b+c@example.org please": {"email"}, "my mail is KELA_B [at] post.example.org": {"email"}, "cc k at corp dot example dot net": {"email"}, "ssh deploy@node-13.test and look": set(),
    "clone it from git@forge.test:tools/a-b.git": set(), "pin the package to tool@88.2.1": set(), "@reviewer pattern kept": set(), "ring +44 (0)20 7946 0628 if it hangs": {"phone"}, "call me on 402 555 0181 ext. 75": {"phone"},
    "wrote 9046123456 bytes": set(), "ticket 555-6262 again": set(), "the lantern page lists build 2026-90-1000": set(), "SSN 935-85-1833 must not be in the log": {"id_number"}, "applicant has passport X3695876": {"id_number"},
    "the form holds national insurance QQ 37 56 31 B": {"id_number"}, "the office is at PO Box 161, Ferrinvale": {"address"}, "I live at Dunmarrowgasse 175 in North Osset Quay": {"address"}, "deliver to: 459 larkmoor rd, bellhaven cross": {"address"},
    "ordering follows PO Box style keys": set(), "the harness script broke on line 67 Street of the map file": set(), "Harness 36 is out, Gantry too": set(), "open the Lantern dashboard first": set(), "": set(), "...": set(),
}


@pytest.mark.parametrize("text", CASES)
def test_cases(model, text):
    assert kinds(model, text) == CASES[text]


def test_names(model):
    names = model[0]
    given, family = (next(n for n, k in names if k == kind) for kind in ("given", "family"))
    for text in (f"ask {given} {family} about it", f"thanks, {family}, {given}", f"my name is {given} T. {family}", f"assign this to Dr. {family}", f"{family}-san reviewed this", f"written by {given.upper()} {family.upper()}"):
        assert kinds(model, text) == {"name"}, text
    assert kinds(model, f"send it to {given.lower()}.{family.lower()}@example.org") == {"email"}


def test_decoding_is_the_best_labelling(model):
    rng = random.Random(5)
    for _ in range(200):
        segments = sorted(((s, s + rng.randrange(1, 6), "name", [f"w{i}"]) for i, s in enumerate(rng.choices(range(15), k=6))), key=lambda x: x[1])
        weights = {f"w{i}": rng.uniform(-1, 2) for i in range(6)}
        score = lambda chosen: sum(weights[x[3][0]] for x in chosen)  # noqa: B023, E731
        best = max(score(c) for n in range(7) for c in itertools.combinations(segments, n) if all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(c))))
        got = decode(segments, weights)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(got)) and abs(sum(max(weights[x[3][0]] for x in segments if x[:3] == g) for g in got) - best) < 1e-9


def test_texts_and_masking(spark, duck, sf_dir):
    rows = [(1, "user", '"call me on 402 555 0181 now"'), (2, "user", '[{"type":"text","text":"x"},{"type":"image"},{"type":"text","text":"SSN 935-85-1833 here"},{"type":"tool_result","content":[{"type":"text","text":"a@b.example"}]}]'), (3, "user", "[{cut"), (4, "user", None), (5, None, '"call me on 402 555 0181 now"'), (6, "user", '[{"type":"text","text":5}]'), (7, "user", "7")]
    df = spark.createDataFrame([(i, None if r is None else (r, c), 1) for i, r, c in rows], "row_id bigint, message struct<role:string,content:string>, extra int")
    texts = pii.session_texts(df)
    assert {(r["row_id"], r["block_no"]) for r in texts.collect()} == {(1, 0), (2, 0), (2, 2)}
    names = spark.read.parquet(f"{sf_dir}/name_list.parquet")
    got = {(r["row_id"], r["block_no"]): (r["masked"], r["kinds"]) for r in pii.label_texts(texts, names).collect()}
    assert got == {(1, 0): ("call me on [PHONE] now", ["phone"]), (2, 2): ("SSN [ID] here", ["id_number"])}
    assert pii.label_texts(texts.limit(0), names).count() == 0


def test_found_rows_are_distinct(spark, sf_dir):
    rows = pii.p5_found(spark, sf_dir).collect()
    assert rows and len(rows) == len(set(rows)) and {r["pii_kind"] for r in rows} == {"email", "phone", "id_number", "address", "name"}
