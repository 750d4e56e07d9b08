"""Column expressions: distances, scaling, labels from file names, rounding. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes in their fixed order, and the event types that stand for them in event tables.
CLASSES = ("tornillo", "clavo", "arandela", "tuerca")
EVENT_CLASSES = {"view": "tornillo", "click": "clavo", "purchase": "arandela", "signup": "tuerca"}
LEAST_DISTANCE = 1e-12


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def features(vector: Column, dims: Sequence[int]) -> Column:
    """Chosen dimensions of an array (0-based), as doubles."""
    return F.array(*[F.get(vector, F.lit(d)).cast("double") for d in dims])


def squared_l2(a: Column, b: Column, n: int) -> Column:
    return total([(a[i] - b[i]) * (a[i] - b[i]) for i in range(n)])


def l2(a: Column, b: Column, n: int) -> Column:
    return F.sqrt(squared_l2(a, b, n))


#: Registry: a name stands for an expression wherever an operator takes one.
WEIGHTS: dict[str, Callable[[Column], Column]] = {"uniform": lambda d: F.lit(1.0), "distance": lambda d: 1.0 / F.greatest(d, F.lit(LEAST_DISTANCE))}


def sanitized(x: Column) -> Column:
    """NaN and infinities as 0; null stays null."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x)


def hu(v: Column) -> Column:
    """The signed logarithm of a moment: 0 stays 0."""
    return F.when(v == 0, 0.0).otherwise(-F.signum(v) * F.log10(F.abs(v)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def stem(path: Column) -> Column:
    """Base name without its extension; a leading dot begins a name, not an extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def label_without_digits(path: Column) -> Column:
    """The stem without digits and outer separators, capitalised."""
    s = F.regexp_replace(F.regexp_replace(stem(path), r"[\p{Nd}²³¹]", ""), r"^[_\-. ]+|[_\-. ]+$", "")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20)))


def label_leading(path: Column, ascii_only: bool = False) -> Column:
    """Leading letters of the base name, or `unknown`."""
    s = F.regexp_extract(base_name(path), r"^[A-Za-z]+" if ascii_only else r"^[A-Za-zÁÉÍÓÚáéíóúñÑ]+", 0)
    return F.when(s == "", "unknown").otherwise(s)


def label_first_letters(path: Column) -> Column:
    """First run of letters of the stem, or the stem."""
    s = F.regexp_extract(stem(path), r"\p{L}+", 0)
    return F.when(s == "", stem(path)).otherwise(s)


def word_before_underscore(path: Column) -> Column:
    return F.lower(F.substring_index(base_name(path), "_", 1))


def word_and_speaker(path: Column) -> tuple[Column, Column]:
    """Of `word_speaker_rest.wav` the word and the speaker, of `word_rest.wav` the word alone, in lower case; null where there is none."""
    letters = "[A-Za-zÁÉÍÓÚáéíóúñÑ]"
    word = F.regexp_extract(base_name(path), rf"(?i)^({letters}+)_.+\.wav$", 1)
    speaker = F.regexp_extract(base_name(path), rf"(?i)^{letters}+_([A-Za-z0-9ÁÉÍÓÚáéíóúñÑ]+)_.+\.wav$", 1)
    return tuple(F.when(x != "", F.lower(x)) for x in (word, speaker))


def label_hint(path: Column) -> Column:
    """The first class, by priority, that the name contains."""
    name, out = F.lower(base_name(path)), F.lit("unknown")
    for c in ("clavo", "tornillo", "tuerca", "arandela"):
        out = F.when(name.contains(c), c).otherwise(out)
    return out


def route(path: Column) -> Column:
    """Which handler a new file goes to, by its folder and extension; null if none."""
    p, folder = F.lower(path), F.element_at(F.split(path, "/"), -2)
    return F.when((folder == "comando") & p.endswith(".wav"), "audio").when((folder == "img_new") & p.rlike(r"\.(jpe?g|png)$"), "image")


def command(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w.isin("proporcion", "contar", "salir"), w).otherwise("other")


def bin10(x: Column, low: Column, high: Column) -> Column:
    """Bin 0-9 of x in [low, high], the last one closed; bin 5 where all values are equal."""
    return F.when(high == low, 5).otherwise(F.least(F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * 10), F.lit(9))).cast("int")
