"""Problem 5: body lines into loaded rows or rejects with a reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.operators.skew import join_dimension

#: Fields that hold numbers: the value fields, places and heights.
NUMERIC = ("value", "value_sd", "value_wmo_scale", "latitude", "longitude", "elevation", "intake_height")
CLOCK = ("st_year", "st_month", "st_day", "st_hour", "st_minute", "st_second")
#: Lowest and highest of each clock field, and what an absent one counts as. Days also end with their month.
CLOCK_RANGE = ((1, 9999, 1970), (1, 12, 1), (1, 31, 1), (0, 23, 0), (0, 59, 0), (0, 59, 0))
DIGITS = r"^[0-9]{1,9}$"
DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

_QUOTE, _COMMA, _END = 34, 44, 10


def structural_index(lines: pa.Array, comma: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Fields of many records at once.

    The records are laid end to end. A quote mask and its prefix parity within each record
    say what stands inside quotes; delimiters are commas outside quotes (comma records) or
    stretches of blanks and tabs. Returns how many fields each record has, all fields in
    order (without the blanks around them and, in comma records, without their quotes), and
    per record whether its quoting is broken.
    """
    joined = pc.binary_join_element_wise(pc.replace_substring(lines, "\n", " "), "", "\n")
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset:joined.offset + len(lines) + 1]
    buf = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    end = offsets[1:] - offsets[0] - 1
    start = offsets[:-1] - offsets[0]
    record = np.repeat(np.arange(len(lines)), end - start + 1)
    in_comma = comma[record]
    quote = (buf == _QUOTE) & in_comma
    count = np.cumsum(quote)
    parity = (count - (count[start] - quote[start])[record]) & 1  # after this byte; 1: inside
    is_end = buf == _END
    solid = ~((buf == 32) | (buf == 9) | (buf == 13))
    word = solid & ~is_end

    separator = in_comma & (buf == _COMMA) & (parity == 0)
    # quoting: what opens must follow a separator or the record's start, what closes must precede one or the end
    index = np.arange(len(buf))
    upto = np.maximum.accumulate(np.where(solid, index, -1))  # nearest solid byte, this one or to the left
    onward = np.minimum.accumulate(np.where(solid, index, len(buf))[::-1])[::-1]
    before, after = np.r_[-1, upto[:-1]], np.r_[onward[1:], len(buf) - 1]
    opens, closes = quote & (parity == 1), quote & (parity == 0)
    doubled_open = opens & np.r_[False, closes[:-1]]  # the second quote of a doubled pair reopens at once
    doubled_close = closes & np.r_[opens[1:], False]
    at_start = (before < start[record]) | separator[np.maximum(before, 0)]
    after = np.minimum(after, len(buf) - 1)
    bad = (opens & ~doubled_open & ~at_start) | (closes & ~doubled_close & ~(is_end[after] | separator[after]))
    broken = np.zeros(len(lines), bool)
    broken[record[bad]] = True
    broken |= parity[end] == 1

    # comma records: fields run between separators; blank-separated records: between stretches of blanks
    bare = word & ~in_comma
    stop = separator | (is_end & in_comma)
    s = np.flatnonzero(np.r_[True, stop[:-1]] & in_comma | np.r_[True, is_end[:-1]] & in_comma | bare & ~np.r_[False, bare[:-1]])
    e = np.flatnonzero(stop | np.r_[~bare[1:], True] & bare)
    e = np.where(in_comma[e], e, e + 1)
    counts = np.bincount(record[s], minlength=len(lines))
    a = np.minimum(onward[s], e)
    b = np.maximum(np.r_[0, upto + 1][e], a)
    quoted = in_comma[s] & (b - a >= 2) & (buf[a] == _QUOTE) & (buf[np.maximum(b - 1, 0)] == _QUOTE)
    a, b = a + quoted, b - quoted
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    keep = (np.cumsum(edge)[:-1] > 0) & ~doubled_open
    kept = np.r_[0, np.cumsum(keep)].astype(np.int32)
    fields = pa.StringArray.from_buffers(len(a), pa.py_buffer(np.r_[np.int32(0), np.cumsum(kept[b] - kept[a], dtype=np.int32)].tobytes()), pa.py_buffer(buf[keep].tobytes()))
    return counts, fields, broken


def _numbers(texts: pa.Array, pattern: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether the text is one) of each text; texts that don't match have 0."""
    sound = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), kind)
    out[sound] = texts.filter(pa.array(sound)).to_numpy(zero_copy_only=False).astype(kind)
    return out, sound


def _clock(texts: dict[int, tuple[np.ndarray, pa.Array]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970, sound) of each record from its clock fields; texts: by place in CLOCK, the records that have it and its text."""
    part = np.array([[r[2]] for r in CLOCK_RANGE], np.int64).repeat(n, axis=1)
    sound = np.ones(n, bool)
    for k, (rows, text) in texts.items():
        value, good = _numbers(text, DIGITS, np.int64)
        part[k, rows] = value
        sound[rows] &= good & (value >= CLOCK_RANGE[k][0]) & (value <= CLOCK_RANGE[k][1])
    part[:, ~sound] = np.array([[r[2]] for r in CLOCK_RANGE])
    month = ((part[0] - 1970) * 12 + part[1] - 1).astype("datetime64[M]")
    day = month.astype("datetime64[D]") + (part[2] - 1)
    sound &= day < (month + 1).astype("datetime64[D]")
    return (day.astype(np.int64) * 86_400 + part[3] * 3600 + part[4] * 60 + part[5]) * 1_000_000, sound


def _judge_batches(with_fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            width = batch.column("width").to_numpy(zero_copy_only=False)
            lines = batch.column("raw_line").cast(pa.string())
            counts, fields, broken = structural_index(lines, batch.column("is_comma").to_numpy(zero_copy_only=False))
            first = np.cumsum(counts) - counts
            slots = batch.column("slots").flatten().to_numpy(zero_copy_only=False).reshape(n, len(CLOCK) + len(NUMERIC))
            ignored = batch.column("ignored").to_numpy(zero_copy_only=False)
            readable = ~ignored & (width >= 0) & ~broken & (counts == width)
            held = {}
            for k in range(slots.shape[1]):
                rows = np.flatnonzero(readable & (slots[:, k] > 0))
                held[k] = rows, fields.take(pa.array(first[rows] + slots[rows, k] - 1))
            us, sound_clock = _clock({k: held[k] for k in range(len(CLOCK))}, n)
            sound_numbers, columns = np.ones(n, bool), []
            for k in range(len(CLOCK), slots.shape[1]):
                rows, text = held[k]
                value, good = _numbers(text, DECIMAL, float)
                good &= np.isfinite(value)
                sound_numbers[rows] &= good
                whole = np.full(n, np.nan)
                whole[rows[good]] = value[good]
                columns.append(whole)
            reason = np.select([ignored, width < 0, broken, counts != width, ~sound_clock, ~sound_numbers], [0, 1, 2, 3, 4, 5], 6)
            ok = reason == 6
            has_year = slots[:, 0] > 0
            out = [batch.column("raw_id"), batch.column("record_id"), batch.column("line_no"), pa.array(reason.astype(np.int32)),
                   pa.array(us, mask=~(ok & has_year)), *[pa.array(c, mask=~ok | np.isnan(c)) for c in columns]]
            names = ["raw_id", "record_id", "line_no", "code", "us", *NUMERIC]
            if with_fields:
                texts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), fields)
                out += [batch.column("columns"), texts]
                names += ["columns", "texts"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


#: Reasons in the order in which they are looked for; the first that holds is given.
REASONS = ("no layout", "broken quoting", "field count", "clock", "number")


def load_lines(raw: DataFrame, layout: DataFrame, with_fields: bool = True) -> DataFrame:
    """Every body line as a loaded row or a reject.

    Columns: raw_id, record_id, line_no, loaded (null for blank and # lines, which are
    neither), reason (one of REASONS), fields (map from layout column to text, left out
    with ``with_fields`` off), local_time, and the numeric fields named in NUMERIC.

    Lines, counts and types are judged in one pass over each Arrow batch: the batch's bytes
    are indexed at once, and every clock and number field is checked as one column.

    Defined cases: a null line counts as blank; a null or unknown record_id has no layout,
    nor has one whose columns are null, unnamed or named twice;
    repeated lines and line numbers are all kept; text of any length is read whole; a line
    break inside a line is a blank; years are 1 to 9999; empty tables give no rows; other
    columns are ignored.
    """
    named = layout.where("record_id is not null and size(array_distinct(columns)) = size(columns) and size(array_compact(columns)) = size(columns)")
    dim = named.groupBy("record_id").agg(
        F.max(F.struct("columns", F.element_at("metadata", "dataset_delimiter").alias("delimiter"))).alias("l"))
    slots = F.array(*[F.array_position("l.columns", c).cast("int") for c in (*CLOCK, *NUMERIC)])
    dim = dim.select("record_id", F.size("l.columns").alias("width"), (F.lower("l.delimiter") == "comma").alias("is_comma"), slots.alias("slots"),
                     *([F.col("l.columns").alias("columns")] if with_fields else []))
    rows = raw.select("raw_id", "record_id", "line_no", F.coalesce("raw_line", F.lit("")).alias("raw_line"))
    none = F.array(*[F.lit(0)] * (len(CLOCK) + len(NUMERIC)))
    joined = join_dimension(rows, dim, ["record_id"]).select(
        "raw_id", "record_id", "line_no", "raw_line", F.coalesce("width", F.lit(-1)).alias("width"), F.coalesce("is_comma", F.lit(False)).alias("is_comma"),
        F.coalesce("slots", none).alias("slots"), F.ltrim(F.translate("raw_line", "\t\r", "  ")).rlike("^(?:#|$)").alias("ignored"),
        *(["columns"] if with_fields else []))
    schema = "raw_id long, record_id string, line_no int, code int, us long, " + ", ".join(f"{c} double" for c in NUMERIC)
    judged = joined.mapInArrow(_judge_batches(with_fields), schema + (", columns array<string>, texts array<string>" if with_fields else ""))
    ok = F.col("code") == len(REASONS) + 1
    reason = F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("code") - 1)
    return judged.select(
        "raw_id", "record_id", "line_no", F.when(F.col("code") > 0, ok).alias("loaded"), reason.alias("reason"),
        *([F.when(ok, F.map_from_arrays("columns", "texts")).alias("fields")] if with_fields else []),
        F.timestamp_micros("us").cast("timestamp_ntz").alias("local_time"), *NUMERIC)


def rejected_lines(raw: DataFrame, layout: DataFrame) -> DataFrame:
    return load_lines(raw, layout, with_fields=False).where("not loaded").select("raw_id")
