"""File names, labels and window keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a spelling of a label that occurs in file names. Spellings of persons are a parameter.
LABEL_SPELLINGS = {"smal": "small"}


def normalise(name: Column, spellings: dict[str, str]) -> Column:
    """Lower case, known spellings replaced."""
    low = F.lower(name)
    if not spellings:
        return low
    pairs = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.coalesce(pairs[low], low)


def stem(path: Column | str) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parse_capture(path: Column | str, labels: tuple[str, ...] = ("big", "small"), label_spellings: dict[str, str] | None = None, person_spellings: dict[str, str] | None = None, prefix: str = "csi") -> Column:
    """struct(date, time, person_raw, person, label_raw, label) of ``{prefix}_YYMMDD_HHMMSS_{person}_{label}.csv``.

    Case doesn't matter; null where a name doesn't match, so that skipped files can be listed.
    """
    label_spellings = LABEL_SPELLINGS if label_spellings is None else label_spellings
    name = F.element_at(F.split(path, "/"), -1)
    pattern = rf"(?i)^{prefix}_(\d{{6}})_(\d{{6}})_([A-Za-z]+)_({'|'.join([*labels, *label_spellings])})\.csv$"
    get = lambda i: F.lower(F.regexp_extract(name, pattern, i))
    return F.when(
        F.rlike(name, F.lit(pattern)),
        F.struct(get(1).alias("date"), get(2).alias("time"), get(3).alias("person_raw"), normalise(get(3), person_spellings or {}).alias("person"), get(4).alias("label_raw"), normalise(get(4), label_spellings).alias("label")),
    )


def capture_time(path: Column | str) -> Column:
    """Timestamp from the last two tokens, ``*_YYYYMMDD_HHMMSS``."""
    tokens = F.split(stem(path), "_")
    return F.try_to_timestamp(F.concat(F.get(tokens, F.size(tokens) - 2), F.lit("_"), F.element_at(tokens, -1)), F.lit("yyyyMMdd_HHmmss"))


def window_key(source: Column | str, segment: Column | str, start: Column | str) -> Column:
    return F.format_string("%s_seg%02d_start%04d", source, segment, start)


def parse_window_key(key: Column | str) -> Column:
    """struct(source, segment_id, start_index) of a window key; null where it doesn't match."""
    pattern = r"^(.*)_seg(\d+)_start(\d+)$"
    get = lambda i: F.regexp_extract(key, pattern, i)
    return F.when(F.rlike(key, F.lit(pattern)), F.struct(get(1).alias("source"), get(2).try_cast("int").alias("segment_id"), get(3).try_cast("int").alias("start_index")))


def variant_name(feature: str, steps: int) -> str:
    """The names of feature variants."""
    return {"raw": "raw_amplitude", "diff": "first_difference", "ma": f"ma{steps}_diff", "std": f"rolling_std{steps}", "phase_sincos": "phase_sin_cos", "phase_tdiff": "phase_temporal_diff", "phase_std": f"phase_rolling_std{steps}"}[feature]


def label_id(label: Column | str, classes: list[str]) -> Column:
    """0-based position in the class list, -1 where it is missing."""
    return (F.array_position(F.array(*map(F.lit, classes)), label) - 1).cast("int")
