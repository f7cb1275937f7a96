"""Campaign, station and file-name labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month words used in campaign labels.
MONTH_WORDS = {
    "JAN": 1, "FEV": 2, "MAR": 3, "ABR": 4, "MAI": 5, "JUN": 6, "JUL": 7, "AGO": 8,
    "SET": 9, "OUT": 10, "NOV": 11, "DEZ": 12,
    "JANEIRO": 1, "FEVEREIRO": 2, "MARÇO": 3, "ABRIL": 4, "MAIO": 5, "JUNHO": 6,
    "JULHO": 7, "AGOSTO": 8, "SETEMBRO": 9, "OUTUBRO": 10, "NOVEMBRO": 11, "DEZEMBRO": 12,
}


def campaign_year(label: Column) -> Column:
    text = F.regexp_extract(label, r"((?:19|20)\d\d)", 1)
    return F.when(text != "", text.cast("int"))


def campaign_month(label: Column) -> Column:
    """Month of the first month word in a label."""
    pairs = [F.lit(x) for kv in MONTH_WORDS.items() for x in kv]
    words = F.regexp_extract_all(F.upper(label), F.lit(r"([A-ZÇÃÁÉÍÓÚ]+)"), 1)
    months = F.filter(F.transform(words, lambda w: F.try_element_at(F.create_map(*pairs), w)),
                      lambda m: m.isNotNull())
    return F.try_element_at(months, F.lit(1))


def semester_tag(label: Column) -> Column:
    """``2019S1`` from a label holding a month word and a year; else null."""
    half = F.when(campaign_month(label) <= 6, "S1").when(campaign_month(label) > 6, "S2")
    return F.concat(campaign_year(label).cast("string"), half)


def campaign_date(label: Column) -> Column:
    return F.make_date(campaign_year(label), campaign_month(label), F.lit(1))


# How folders and files name stations, loggers and date spans.
_RH_STATION = r"(?i)RH\s*_?(\d{1,2})"
_CENTROID_STATION = r"(?i)CENTROID\w*\s*(\d+)"
_NO_STATION = "EXPERIMENTO"
_LEADING_LOGGER = r"(?i)^hobo\s*\d*[_\-\s]*"
_TRAILING_LOGGER = r"(?i)[_\-\s]*hobo\s*\d*$"
_DATE_SPAN = r"(\d{6})[_\-](\d{6})"
_LABEL_LENGTH = 24


def station_label(subpath: Column, names: Column) -> Column:
    """Station of an experiment folder from its path and file names."""
    hay = F.concat_ws(" ", subpath, names)
    rh, centre = (F.regexp_extract(hay, p, 1) for p in (_RH_STATION, _CENTROID_STATION))
    leaf = F.element_at(F.split(subpath, r"[/\\]"), -1)
    clean = F.substring(F.upper(F.trim(F.regexp_replace(leaf, "[^A-Za-z0-9]+", "_"), F.lit("_"))), 1, _LABEL_LENGTH)
    return (F.when(rh != "", F.concat(F.lit("RH"), rh))
            .when(centre != "", F.concat(F.lit("CENTROID"), centre))
            .when(F.coalesce(subpath, F.lit("")).isin("", ".") | (clean == ""), _NO_STATION)
            .otherwise(clean))


def replicate_stem(name: Column) -> Column:
    """File stem without its logger number and separators."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, _LEADING_LOGGER, "")
    stem = F.regexp_replace(stem, _TRAILING_LOGGER, "")
    return F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "")


def named_dates(name: Column) -> Column:
    """First and last day written as ``ddMMyy_ddMMyy`` in a file name."""
    def day(group: int) -> Column:
        text = F.regexp_extract(name, _DATE_SPAN, group)
        part = [F.substring(text, i, 2).try_cast("int") for i in (1, 3, 5)]
        made = F.try_make_timestamp_ntz(part[2] + 2000, part[1], part[0], F.lit(0), F.lit(0), F.lit(0.0))
        return F.when(text != "", made)
    first, last = day(1), day(2)
    both = first.isNotNull() & last.isNotNull()
    return F.struct(F.when(both, first).alias("first"), F.when(both, last).alias("last"))
