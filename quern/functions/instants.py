"""Reading times of many forms as integers: one regular expression, then day arithmetic.

All forms are alternatives of a single pattern with named groups. One
``regexp_replace`` writes the groups of whichever alternative matched in a fixed
order, so a text is matched once; the parts are then checked against the calendar
and put together with integer arithmetic. No step depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import evaluated

#: Offsets in seconds of zone abbreviations that logs write.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0,
    "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000,
    "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200,
    "BST": 3600, "WEST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800,
    "JST": 32400, "AEST": 36000, "AEDT": 39600, "BRT": -10800,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_CLOCK = r"(?<h{k}>\d{{1,2}}):(?<i{k}>\d{{2}})(?::(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d{{1,9}}))?)?"
_ZONE = r"(?: ?(?<z{k}>[A-Za-z]{{1,4}}|[+-]\d{{2}}(?::?\d{{2}})?))?"

#: name of the form -> its alternative; ``{k}`` marks the form's own groups.
FORMS = {
    "a": r"(?<y{k}>\d{{4}})-(?<m{k}>\d{{1,2}})-(?<d{k}>\d{{1,2}})[Tt ]" + _CLOCK + _ZONE,
    "b": r"(?<y{k}>\d{{4}})/(?<m{k}>\d{{1,2}})/(?<d{k}>\d{{1,2}})[Tt ]" + _CLOCK + _ZONE,
    "c": r"(?<y{k}>\d{{4}})(?<m{k}>\d{{2}})(?<d{k}>\d{{2}})[Tt ](?<h{k}>\d{{2}})(?<i{k}>\d{{2}})(?:(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d{{1,9}}))?)?" + _ZONE,
    "d": r"(?<d{k}>\d{{1,2}})\.(?<m{k}>\d{{1,2}})\.(?<y{k}>\d{{4}}),? " + _CLOCK + _ZONE,
    "e": r"(?:[A-Za-z]{{3,9}},? )?(?<d{k}>\d{{1,2}})[ -](?<m{k}>[A-Za-z]{{3}})[a-z]*[ -](?<y{k}>\d{{4}}),? " + _CLOCK + _ZONE,
    "f": r"(?<m{k}>\d{{1,2}})/(?<d{k}>\d{{1,2}})/(?<y{k}>\d{{4}}),? " + _CLOCK + r" ?(?<p{k}>[AaPp])\.?[Mm]\.?" + _ZONE,
    "g": r"(?<n{k}>\d{{9,19}})(?:\.(?<f{k}>\d{{1,9}}))?",
}
PARTS = "ymdhisfpzn"
_MARK = "\u0001"


def _has(form: str, part: str) -> bool:
    return f"<{part}{form}>" in FORMS[form].format(k=form)


PATTERN = "^(?:" + "|".join(body.format(k=form) for form, body in FORMS.items()) + ")$"
REPLACEMENT = _MARK + "|".join("".join(f"${{{part}{form}}}" for form in FORMS if _has(form, part)) for part in PARTS)

#: The stores' own forms: ISO with six fraction digits and ``+00:00``, and epoch milliseconds.
OWN_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$"


def read_times(df: DataFrame, text: Column, prefix: str = "t_") -> DataFrame:
    """Add what a time says, without any machine's clock.

    ``<prefix>sec``: UTC second, or null; ``<prefix>local``: second on an unnamed
    clock, or null; ``<prefix>nano``: rest in nanoseconds. All null where the text is
    null, empty, of no known form, or not a time of the calendar.
    """
    p = prefix
    column = lambda name: F.col(p + name)
    matched = F.regexp_replace(F.trim(text), PATTERN, REPLACEMENT)
    df = evaluated(df, {p + "m": matched})
    df = evaluated(df, {p + "x": F.when(column("m").startswith(_MARK), F.split(column("m").substr(F.lit(2), F.length(column("m"))), r"\|", -1))})
    part = {name: F.get(column("x"), F.lit(i)) for i, name in enumerate(PARTS)}
    whole = lambda c: F.nullif(c, F.lit("")).try_cast("bigint")

    named = F.expr(f"locate(lower({p}x[1]), '{MONTHS}')")
    month = F.when(part["m"].rlike("^[A-Za-z]"), F.when(named % 3 == 1, F.floor((named + 2) / 3))).otherwise(whole(part["m"]))
    hour, half = whole(part["h"]), F.lower(part["p"])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    df = evaluated(
        df,
        {
            p + "y": whole(part["y"]), p + "mo": month.cast("bigint"), p + "d": whole(part["d"]), p + "h": hour,
            p + "mi": whole(part["i"]), p + "s": F.when(part["s"] == "", F.lit(0).cast("bigint")).otherwise(whole(part["s"])),
            p + "f": whole(F.rpad(part["f"], 9, "0")), p + "z": part["z"], p + "n": part["n"],
        },
    )

    e = lambda sql: F.expr(sql.replace("$", p))
    leap = "($y % 4 = 0 and ($y % 100 <> 0 or $y % 400 = 0))"
    last_day = f"(case when $mo = 2 then if({leap}, 29, 28) when $mo in (4, 6, 9, 11) then 30 else 31 end)"
    valid = f"$y >= 1 and $mo between 1 and 12 and $d between 1 and {last_day} and $h between 0 and 23 and $mi between 0 and 59 and $s between 0 and 59"
    # days since 1970-01-01 of a civil date, counted from a year that begins in March
    year = "($y - if($mo <= 2, 1, 0))"
    day_of_year = "((153 * ($mo + if($mo > 2, -3, 9)) + 2) div 5 + $d - 1)"
    days = f"(365 * {year} + {year} div 4 - {year} div 100 + {year} div 400 + {day_of_year} - 719468)"
    clock = f"({days} * 86400 + $h * 3600 + $mi * 60 + $s)"
    offset_text = "(if(substr($z, 1, 1) = '-', -1, 1) * (try_cast(substr($z, 2, 2) as bigint) * 3600 + coalesce(try_cast(right(regexp_replace(substr($z, 4), ':', ''), 2) as bigint), 0) * 60))"
    names = "map(" + ", ".join(f"'{k}', {v}L" for k, v in ABBREVIATIONS.items()) + ")"
    offset = f"(case when $z rlike '^[+-]' then if(abs({offset_text}) <= 54000, {offset_text}, null) else try_element_at({names}, upper($z)) end)"
    length = "length($n)"
    unit = f"(case when {length} <= 11 then 1L when {length} <= 14 then 1000L when {length} <= 17 then 1000000L else 1000000000L end)"
    number = "try_cast(nullif($n, '') as bigint)"

    df = evaluated(df, {p + "clock": F.when(e(valid), e(clock)), p + "off": F.when(column("z") != "", e(offset))})
    epoch = e(f"case when {number} > 0 then {number} div {unit} end")
    epoch_nano = e(f"case when {length} <= 11 then coalesce($f, 0L) else ({number} % {unit}) * (1000000000L div {unit}) end")
    is_epoch = column("n") != ""
    df = evaluated(
        df,
        {
            p + "sec": F.when(is_epoch, epoch).when(column("z") != "", column("clock") - column("off")),
            p + "local": F.when(~is_epoch & (column("z") == ""), column("clock")),
            p + "nano": F.when(is_epoch, epoch_nano).otherwise(F.coalesce(column("f"), F.lit(0))).cast("bigint"),
        },
    )
    return df.drop(*(p + c for c in ("m", "x", "y", "mo", "d", "h", "mi", "s", "f", "z", "n", "clock", "off")))


def readings_of(local: Column, zone: Column) -> tuple[Column, Column]:
    """The earlier and later UTC second at which a clock in ``zone`` shows ``local``.

    They differ where the clock shows the time twice; both are null where it is skipped.
    """

    def shown(second: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(second), zone))

    before, after = local - F.lit(86400), local + F.lit(86400)
    a, b = local - (shown(before) - before), local - (shown(after) - after)
    a, b = F.when(shown(a) == local, a), F.when(shown(b) == local, b)
    return F.least(a, b), F.greatest(a, b)
