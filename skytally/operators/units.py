"""Problem 2: one quantity in many unit spellings to common units."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.operators.skew import join_dimension
from skytally.session import cut

#: Mole fraction that one of the unit is.
SCALE = {"mol/mol": 1.0, "%": 1e-2, "mmol/mol": 1e-3, "umol/mol": 1e-6, "nmol/mol": 1e-9, "pmol/mol": 1e-12}
#: Known ways of writing each unit, from which distinct spellings are matched.
ALIASES = {
    "mol/mol": ["mol/mol", "mol mol-1", "mol per mol", "mole/mole"],
    "%": ["%", "percent", "per cent", "percent by volume", "vol %"],
    "mmol/mol": ["mmol/mol", "mmol mol-1", "millimol per mol", "per mille", "permille", "10-3 mol/mol"],
    "umol/mol": ["umol/mol", "umol mol-1", "micromol per mol", "ppm", "ppmv", "ppm by volume", "10-6 mol/mol", "parts per million"],
    "nmol/mol": ["nmol/mol", "nmol mol-1", "nanomol per mol", "ppb", "ppbv", "ppb by volume", "10-9 mol/mol", "parts per billion"],
    "pmol/mol": ["pmol/mol", "pmol mol-1", "picomol per mol", "ppt", "pptv", "10-12 mol/mol", "parts per trillion"],
}
#: The common unit of each gas.
TARGET = {"CO2": 1e-6, "CH4": 1e-9}
#: What loaders write for "no value".
SENTINELS = (-999.999, -999999.999, -999.999999999)

NGRAM = 2
#: A spelling is matched up to this share of its length in weighted edits.
MAX_COST_SHARE = 0.18
#: Words that an alias may gain in a remark and still be within MAX_COST_SHARE, such as "(dry)".
EXTRA_WORDS = 1

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_NUMBER = re.compile(r"^[+-]?\d+(?:[.,]\d+)?$")


def fold(text: str) -> str:
    """Lower case, one micro sign, plain digits, no carets, single blanks."""
    t = unicodedata.normalize("NFKC", text.translate(_SUPER)).lower()
    t = t.replace("μ", "u").replace("µ", "u").replace("−", "-").replace("^", "")
    t = re.sub(r"\(\s*dry\s*\)|\bdry\b", " ", t)
    return re.sub(r"\s+", " ", t).strip()


def grams(text: str) -> list[str]:
    t = f"\u0002{text}\u0003"
    return sorted({t[i:i + NGRAM] for i in range(len(t) - NGRAM + 1)})


def _weight(c: str) -> float:
    if c in " /.-_()[]":
        return 0.15
    return 4.0 if c in "%0123456789munpkbt" else 1.0


def edit_cost(a: str, b: str, limit: float = float("inf")) -> float:
    """Edit distance in which separators are cheap and what carries scale is dear; infinite beyond ``limit``."""
    if a == b:
        return 0.0
    wb = [_weight(c) for c in b]
    row = [0.0]
    for w in wb:
        row.append(row[-1] + w)
    for x in a:
        wx = _weight(x)
        new = [row[0] + wx]
        for j, y in enumerate(b):
            w = wb[j]
            new.append(min(row[j] + (0.0 if x == y else max(wx, w)), row[j + 1] + wx, new[j] + w))
        if min(new) > limit:
            return float("inf")
        row = new
    return row[-1]


def most_words() -> int:
    """Words of the longest alias, and EXTRA_WORDS; a longer stretch of a remark matches none."""
    return max(len(a.split()) for names in ALIASES.values() for a in names) + EXTRA_WORDS


def unit_windows(remark: str) -> list[tuple[int, str]]:
    """(words, text) of every stretch of a remark that may be a unit. A number right before makes it a quantity."""
    most = most_words()
    words = [m.group() for m in re.finditer(r"\S+", remark)]
    out = []
    for i in range(len(words)):
        if i and _NUMBER.match(words[i - 1]) and words[i][0] not in "([{":
            continue
        for k in range(1, min(most, len(words) - i) + 1):
            t = re.sub(r"^[\[({\"'=:]+|[\])}\"'.,;:!]+$", "", " ".join(words[i:i + k]))
            if t.count("(") > t.count(")"):
                t += ")"
            if t:
                out.append((k, t))
    return out


def alias_dictionary(spellings: DataFrame, column: str) -> DataFrame:
    """Distinct spellings with the unit they mean: (column, unit_code, cost).

    Character n-grams of the distinct spellings meet those of ALIASES through an inverted
    index (an equi-join on the gram); pairs that share half of their grams are verified
    by weighted edit distance and the cheapest within MAX_COST_SHARE wins, ties by unit.
    Spellings that match nothing are absent.
    """
    spark = spellings.sparkSession
    index = spark.createDataFrame(
        [(g, a, u, len(grams(a))) for u, names in ALIASES.items() for a in sorted({fold(x) for x in names}) for g in grams(a)],
        "gram string, alias string, unit_code string, alias_grams int")

    @F.pandas_udf("struct<folded string, grams array<string>>")
    def prepare(s: pd.Series) -> pd.DataFrame:
        folded = s.map(fold)
        return pd.DataFrame({"folded": folded, "grams": folded.map(grams)})

    prepare = prepare.asNondeterministic()  # else filters and projections each run it again

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_cost(x, y, MAX_COST_SHARE * len(x)) for x, y in zip(a, b)], dtype=float)

    cost = cost.asNondeterministic()
    own = (spellings.where(F.col(column).isNotNull()).select(column).distinct()
           .withColumn("_p", prepare(column)).select(column, "_p.folded", "_p.grams").where("folded <> ''"))
    hits = own.select(column, "folded", F.size("grams").alias("own_grams"), F.explode("grams").alias("gram")).join(F.broadcast(index), "gram")
    pairs = (hits.groupBy(column, "folded", "own_grams", "alias", "unit_code", "alias_grams").agg(F.count(F.lit(1)).alias("shared"))
             .where(F.col("shared") * 2 >= F.greatest("own_grams", "alias_grams")))
    scored = pairs.withColumn("cost", cost("folded", "alias")).where(F.col("cost") <= F.lit(MAX_COST_SHARE) * F.length("folded"))
    return (scored.groupBy(column).agg(F.min(F.struct("cost", "unit_code")).alias("best"))
            .select(column, F.col("best.unit_code").alias("unit_code"), F.col("best.cost").alias("cost")))


def text_dictionary(texts: DataFrame) -> DataFrame:
    """Distinct (is_remark, text) that name a unit: (is_remark, text, unit_code).

    A unit or layout text is one spelling; a remark is cut into the stretches that may be
    units, of which the cheapest wins, then the longest, then the first. All spellings go
    through one alias dictionary.
    """

    @F.pandas_udf("array<struct<at int, words int, piece string>>")
    def windows(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"at": i, "words": k, "piece": w} for i, (k, w) in enumerate(unit_windows(t))])

    windows = windows.asNondeterministic()
    known = texts.where("text is not null").distinct()
    whole = known.where("not is_remark").select("is_remark", "text", F.lit(0).alias("at"), F.lit(0).alias("words"), F.col("text").alias("piece"))
    cuts = known.where("is_remark").withColumn("_w", windows("text")).select("is_remark", "text", F.inline("_w"))
    pieces = cut(whole.unionByName(cuts))
    best = F.min_by("unit_code", F.struct("cost", -F.col("words"), "at"))
    return pieces.join(alias_dictionary(pieces.select("piece"), "piece"), "piece").groupBy("is_remark", "text").agg(best.alias("unit_code"))


def _map(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def is_sentinel(c: Column) -> Column:
    return c.isin(*SENTINELS)


def convert_units(incoming: DataFrame, layout: DataFrame) -> DataFrame:
    """obs_incoming with the unit each value stands in and the value in the gas's common unit.

    The unit is that of ``unit``; if that is null, blank or a dash, the one in ``remark``;
    else that of the layout. Columns: row_id, record_id, original_value, given, unit_code,
    unit_source (unit, remark, layout), right_value.

    Defined cases: a spelling that matches no unit gives a null unit_code and right_value
    (it isn't replaced by the layout's); a null, NaN or sentinel original_value gives a null
    right_value; rows without a layout have no gas and so no right_value; repeated rows
    stay; empty tables give no rows; other columns of the inputs are ignored.
    """
    stated = F.when(~F.trim(F.coalesce("unit", F.lit(""))).isin("", "-", "–", "—"), F.trim("unit"))
    rows = incoming.select("row_id", "record_id", "original_value", F.col("value").alias("given"),
                           stated.isNull().alias("is_remark"), F.coalesce(stated, "remark").alias("text"))
    dim = layout.where("record_id is not null").groupBy("record_id").agg(F.max("species").alias("species"), F.max("unit").alias("layout_text"))
    texts = rows.select("is_remark", "text").unionByName(dim.select(F.lit(False).alias("is_remark"), F.col("layout_text").alias("text")))
    units = cut(text_dictionary(texts))
    of_layout = units.where("not is_remark").select(F.col("text").alias("layout_text"), F.col("unit_code").alias("layout_unit"))
    dim = dim.join(of_layout, "layout_text", "left").select("record_id", "species", "layout_unit")
    joined = join_dimension(join_dimension(rows, units, ["is_remark", "text"]), dim, ["record_id"])
    source = F.when(~F.col("is_remark"), "unit").when(F.col("unit_code").isNotNull(), "remark").otherwise("layout")
    code = F.when(F.col("is_remark"), F.coalesce("unit_code", "layout_unit")).otherwise(F.col("unit_code"))
    known = F.col("original_value").isNotNull() & ~F.isnan("original_value") & ~is_sentinel(F.col("original_value"))
    factor = _map(SCALE, code) / _map(TARGET, F.upper(F.trim("species")))
    return joined.select("row_id", "record_id", "original_value", "given", code.alias("unit_code"), source.alias("unit_source"),
                         F.when(known, F.col("original_value") * factor).alias("right_value"))


def wrong_values(incoming: DataFrame, layout: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Rows whose given value is more than ``tolerance`` (relative) off the right conversion."""
    known = F.col("given").isNotNull() & ~F.isnan("given") & F.col("right_value").isNotNull()
    off = F.abs(F.col("given") - F.col("right_value")) > tolerance * F.abs("right_value")
    return convert_units(incoming, layout).where(known & off).select("row_id")
