"""What a request says: keyword syntax, named scopes, the time block."""

from __future__ import annotations

import datetime
import os
import re
import zoneinfo
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r'"([^"]+)"|\{(\w+)(?::([^}]*))?\}|\[([^\]=]+)(?:=([^\]]*))?\]|(\S+)')


@dataclass
class KeywordQuery:
    """``words "exact phrase" {type:page} {in_name:term} {created_by:me} [tag=value]``, taken apart."""

    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str | None] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> KeywordQuery:
        out = cls()
        for phrase, name, value, tag, tag_value, word in _PART.findall(text or ""):
            if phrase:
                out.phrases.append(phrase)
            elif name:
                out.filters[name] = value
            elif tag:
                out.tags[tag.strip()] = tag_value.strip() or None
            elif word:
                out.words.append(word)
        return out

    def condition(self, caller: str | None = None) -> Column:
        """Over rows (type, name, text, created_by, tags: map): all but the ranking of the words. The parts are literals, so they reach the scan where it can take them."""
        both = F.lower(F.concat_ws("\n", "name", "text"))
        parts = [both.contains(p.lower()) for p in self.phrases]
        if "type" in self.filters:
            parts.append(F.col("type").isin(self.filters["type"].split("|")))
        if "in_name" in self.filters:
            parts.append(F.lower("name").contains(self.filters["in_name"].lower()))
        if "created_by" in self.filters:
            who = self.filters["created_by"]
            parts.append(F.col("created_by") == F.lit(caller if who == "me" else who))
        for tag, value in self.tags.items():
            found = F.try_element_at("tags", F.lit(tag))
            parts.append(found.isNotNull() if value is None else found == value)
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def keyword_filter(rows: DataFrame, text: str, caller: str | None = None) -> DataFrame:
    return rows.filter(KeywordQuery.parse(text).condition(caller))


SCOPE_KINDS = ("shelves", "books", "chapters", "pages")


def merge_scopes(*scopes: dict[str, list[int]]) -> dict[str, list[int]]:
    return {k: sorted({i for s in scopes for i in s.get(k, ())}) for k in SCOPE_KINDS}


def named_scopes(definitions: dict[str, dict[str, list[int]]], names: list[str]) -> tuple[dict[str, list[int]], list[str]]:
    """The union of the named scopes, and the names that are not known."""
    return merge_scopes(*[definitions[n] for n in names if n in definitions]), [n for n in names if n not in definitions]


def time_zone(variable: str = "DEFAULT_TIMEZONE") -> tuple[str, str]:
    """(name, source): from the variable, else from TZ, else UTC; names that are no zones are passed over."""
    for source, name in (("env", os.environ.get(variable, "")), ("tz", os.environ.get("TZ", ""))):
        try:
            if name.strip():
                zoneinfo.ZoneInfo(name.strip())
                return name.strip(), source
        except (zoneinfo.ZoneInfoNotFoundError, ValueError):
            pass
    return "UTC", "utc"


def time_block(now: datetime.datetime, zone: str, source: str) -> dict[str, object]:
    local, utc = now.astimezone(zoneinfo.ZoneInfo(zone)), now.astimezone(datetime.timezone.utc)
    return {
        "now_unix": int(utc.timestamp()),
        "now_utc": utc.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "now_local": local.isoformat(timespec="seconds"),
        "now_human": f"{local:%A, %B} {local.day}, {local.year} at {local.hour % 12 or 12}:{local:%M %p %Z}",
        "timezone": zone,
        "timezone_source": source,
    }


def time_columns(now: Column, zone: str, source: str) -> Column:
    """The time block of each timestamp, with the fields of ``time_block``."""
    local = F.from_utc_timestamp(now, zone)
    offset = F.unix_seconds(local) - F.unix_seconds(now)
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    sign = F.when(offset < 0, "-").otherwise("+")
    shift = F.concat(sign, two(F.floor(F.abs(offset) / 3600)), F.lit(":"), two(F.floor(F.abs(offset) % 3600 / 60)))
    return F.struct(
        F.unix_seconds(now).alias("now_unix"),
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("now_utc"),
        F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), shift).alias("now_local"),
        F.date_format(local, "EEEE, MMMM d, yyyy 'at' h:mm a").alias("now_human"),
        F.lit(zone).alias("timezone"),
        F.lit(source).alias("timezone_source"),
    )
