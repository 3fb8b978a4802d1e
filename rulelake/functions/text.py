"""Scalar expressions over strings, all of them Catalyst expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that say nothing about a text's subject.
STOP_WORDS = ("the a an of to for in on at by is are be and or but with as it its this that you your we our i me").split()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def leaf(c: Column, separator: str = "::") -> Column:
    """What follows the last separator."""
    return F.element_at(F.split(c, re.escape(separator)), -1)


def glob(c: Column, pattern: str) -> Column:
    """Whole-string match; * stands for any run, ? for one character."""
    body = "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in pattern)
    return c.rlike(f"(?s)^{body}$")


def path_glob(c: Column, pattern: str) -> Column:
    """Whole-string match; ** stands for any run, * for one without a slash, and nothing else is special."""
    parts = re.split(r"(\*\*|\*)", pattern)
    body = "".join({"**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in parts)
    return c.rlike(f"(?s)^{body}$")


def names(c: Column, wanted: str) -> Column:
    """Equal, by wildcard, or a suffix of the qualified name that starts at a colon."""
    if "*" in wanted or "?" in wanted:
        return glob(c, wanted)
    if wanted.startswith(":"):
        return c.endswith(wanted)
    return (c == wanted) | c.endswith(":" + wanted)


def json_string(c: Column) -> Column:
    """The JSON string of a value that is not null."""
    told = F.to_json(F.array(c))
    return F.substring(told, F.lit(2), F.length(told) - 2)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of two bytes or more without stop words, in no particular order."""
    words = F.array_distinct(F.split(ascii_lower(c), r"[^\p{IsAlphabetic}\p{N}]+"))
    return F.filter(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))), lambda w: F.octet_length(w) > 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets, in single precision; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union).cast("float")


def shown(c: Column, first: int = 12) -> Column:
    """The first characters and how many more there are."""
    more = F.length(c) - first
    return F.when(more > 0, F.concat(F.substring(c, 1, first), F.lit("…["), more.cast("string"), F.lit(" more chars redacted]"))).otherwise(c)


def shortened(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def excerpt(c: Column, start: Column, length: Column, around: int = 20) -> Column:
    """A match (0-based start) with so many characters on both sides."""
    begin = F.greatest(start - around, F.lit(0))
    return F.substring(c, (begin + 1).cast("int"), (start - begin + length + around).cast("int"))


def occurrences(c: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    n = F.octet_length(needle)
    return F.when(n > 0, ((F.octet_length(c) - F.octet_length(F.replace(c, needle, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def seconds(token: Column) -> Column:
    """30m, 24h, 7d, 2w as seconds; null if it is none."""
    n = F.regexp_extract(token, r"^(\d+)[smhdw]$", 1).try_cast("long")
    unit = F.create_map(*[F.lit(x) for kv in {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}.items() for x in kv])
    return n * F.try_element_at(unit, F.substring(token, -1, 1))


def humanised(secs: Column) -> Column:
    """Whole days, hours, minutes or seconds, whichever is the largest unit that fits."""
    pick = F.when(secs >= 86400, F.concat(F.floor(secs / 86400), F.lit("d")))
    pick = pick.when(secs >= 3600, F.concat(F.floor(secs / 3600), F.lit("h"))).when(secs >= 60, F.concat(F.floor(secs / 60), F.lit("m")))
    return pick.otherwise(F.concat(secs.cast("long"), F.lit("s")))


def clock(ts: Column) -> dict[str, Column]:
    """weekday, hour and business hours (Monday to Friday, from 9 to before 17) of a timestamp."""
    weekday, hour = F.date_format(ts, "EEEE"), F.hour(ts)
    return {"weekday_local": F.lower(weekday), "hour_local": hour.cast("string"),
            "business_hours_local": (F.weekday(ts).between(0, 4) & hour.between(9, 16)).cast("string")}


def escaped(c: Column) -> Column:
    """Percent-escapes % and : so that joined parts stay apart."""
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))


def fact_id(namespace: Column, predicate: Column, args: Column, occurrence: Column) -> Column:
    """An injective id of a fact: escaped parts joined by colons, and the occurrence among equal facts from the second on."""
    joined = F.array_join(F.transform(F.concat(F.array(namespace, predicate), args), escaped), ":")
    return F.when(occurrence > 0, F.concat(joined, F.lit("#"), occurrence.cast("string"))).otherwise(joined)


def segments(command: Column) -> Column:
    """The simple commands of a shell line: cut at && || ; | and line ends, environment prefixes and comments off."""
    parts = F.split(F.regexp_replace(command, r"(?m)(^|\s)#[^\n]*$", "$1"), r"&&|\|\||[;|\n]")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*([A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")))
    return F.filter(bare, lambda p: p != "")


def normalised_path(path: Column) -> Column:
    """Slashes for backslashes, no doubled slashes, no ./ parts, no leading ./ or trailing slash; a/../b becomes b."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(
        (p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
        F.concat(acc, F.array(p))))
    return F.concat(F.when(path.startswith("/") | path.startswith("\\"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def code_text(command: Column) -> Column:
    """A shell text without what is only data: heredoc bodies, quoted strings and comments."""
    bare = F.regexp_replace(command, r"(?s)<<-?\s*(['\"]?)(\w+)\1(.*?)\n\s*\2\b", "")
    bare = F.regexp_replace(bare, r"""'[^']*'|"(?:\\.|[^"\\])*\"""", "")
    return F.regexp_replace(bare, r"(?m)(^|\s)#.*$", "$1")


def command_matches(command: Column, words: str, in_code: bool = True) -> Column:
    """Whether a simple command starts with the words (blanks count as one); in_code: outside quotes and heredocs."""
    text = code_text(command) if in_code else command
    return F.exists(segments(text), lambda s: F.startswith(F.concat(F.regexp_replace(s, r"\s+", " "), F.lit(" ")), F.lit(words + " ")))


def fnv1a64(c: Column) -> Column:
    """FNV-1a over the bytes of a text, as 16 hexadecimal digits. Catalyst has no wrapping multiplication, so this one hash
    runs over Arrow batches: column by column of bytes for all rows at once."""
    import numpy as np

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        data = [None if v is None else v.encode() for v in values]
        out = np.full(len(data), 0xCBF29CE484222325, np.uint64)  # fixed values: the public offset basis and prime
        order = sorted(range(len(data)), key=lambda i: -len(data[i] or b""))
        sizes = np.array([len(data[i] or b"") for i in order])
        block = 4096
        with np.errstate(over="ignore"):
            for at in range(0, int(sizes[0]) if len(sizes) else 0, block):
                live = order[:int((sizes > at).sum())]
                part = [data[i][at:at + block] for i in live]
                wide = np.zeros((len(part), max(map(len, part))), np.uint8)
                for k, p in enumerate(part):
                    wide[k, :len(p)] = np.frombuffer(p, np.uint8)
                ends = np.array([len(p) for p in part])
                state, rows = out[live], np.arange(len(live))
                for k in range(wide.shape[1]):
                    rows = rows[:int((ends > k).sum())]
                    state[rows] = (state[rows] ^ wide[rows, k]) * np.uint64(0x100000001B3)
                out[live] = state
        return pd.Series([None if d is None else f"{v:016x}" for d, v in zip(data, out.tolist())])
    return run(c)


def anchor(c: Column, digits: int = 12) -> Column:
    """A short content anchor: the first digits of the SHA-256 of a text whose line ends and outer blanks are normalised."""
    return F.substring(F.sha2(F.trim(F.replace(c, F.lit("\r\n"), F.lit("\n"))), 256), 1, digits)


def pointer(json: Column, path: str) -> Column:
    """The value at a JSON pointer (~1 is a slash, ~0 a tilde), as text; null if there is none."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    quoted = "$" + "".join(f"[{p}]" if p.isdecimal() else "['" + p.replace("'", "\\'") + "']" for p in parts)
    return F.get_json_object(json, quoted) if path else json


def json_strings(c: Column) -> Column:
    """All string values of a JSON text, however deep, in order."""
    told = F.filter(F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0)), lambda s: ~s.endswith(":"))
    return F.transform(told, lambda s: F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0])
