"""Detection and replacement of sensitive text."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shown

#: What is looked for, its severity, and whether a match without a digit only warns.
DETECTORS = (
    ("private-key header", "error", False, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    ("credential-bearing URL", "error", False, r"""[a-zA-Z][a-zA-Z0-9+.\-]{0,15}://[^/\s:@"',]{0,64}:[^@\s"',]{1,256}@"""),
    ("token/secret assignment", "error", True,
     r"""(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|client[_-]?secret|secret[_-]?key|private[_-]?key|password|passwd)["'\\]{0,4}\s*[:=]\s*["'\\]{0,4}[A-Za-z0-9+/_.\-]{8,}"""),
    ("bearer token", "error", True, r"(?i)\bbearer(?:\s+|:\s*)[A-Za-z0-9\-._~+/]{16,}"),
    ("secret-suggesting environment key", "error", True,
     r"""\b[A-Z][A-Z0-9_]{2,40}(?:TOKEN|SECRET|PASSWORD|APIKEY|API_KEY|PRIVATE_KEY|CREDENTIALS)["'\\]{0,4}\s*[:=]\s*["'\\]{0,4}\S{4,}"""),
    ("email address", "warning", False, r"\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,128}\.[A-Za-z]{2,24}\b"),
)
#: Absolute paths of two segments or more, and the roots under which they tell nothing.
ABSOLUTE = r"/[A-Za-z0-9._+\-]{1,64}(?:/[A-Za-z0-9._+\-]{1,64}){1,32}"
NEUTRAL = ("/usr", "/bin", "/sbin", "/etc", "/opt", "/lib", "/lib64", "/dev", "/proc", "/sys", "/run", "/System", "/Library")
#: A path counts at the text's start, after file://, after an escaped line end or tab, or after anything that is no
#: word character, slash, dot or tilde. The pattern starts with the slash itself, which is quickly searched for.
BOUNDED = r"/(?:(?<=^/)|(?<=file:///)|(?<=\\[ntr]/)|(?<![\p{IsAlphabetic}\p{N}/.~]/))" + ABSOLUTE[1:]
PATHS = "absolute path outside the project placeholder roots"
#: What a text must hold (in lower case for the last three) for a detector to match; others are not searched.
NEEDS = {"private-key header": ("PRIVATE KEY-----",), "credential-bearing URL": ("://",), "email address": ("@",), "bearer token": ("bearer",),
         "token/secret assignment": ("key", "token", "secret", "passw"), "secret-suggesting environment key": ("token", "secret", "password", "key", "credentials")}
KINDS = (*(d[0] for d in DETECTORS), PATHS)


def findings(rows: DataFrame, text: str = "text", kinds: Sequence[str] = KINDS) -> DataFrame:
    """rows with what, severity and a redacted hint for each finding of these kinds. A text is searched for a kind only if it
    holds one of the plain strings that the kind cannot do without."""
    c, low, told = F.col(text), F.lower(F.col(text)), []
    for what, severity, soft, pattern in DETECTORS:
        if what in kinds:
            level = lambda m, s=severity, d=soft: F.when(F.lit(d) & ~m.rlike("[0-9]"), "warning").otherwise(s)
            holds = reduce(operator.or_, (F.contains(low if x.islower() else c, F.lit(x)) for x in NEEDS[what]))
            told.append(F.when(holds, F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), _finding(what, level))))
    if PATHS in kinds:
        paths = F.filter(F.regexp_extract_all(c, F.lit(BOUNDED), F.lit(0)), _not_neutral)
        told.append(F.when(F.contains(c, F.lit("/")), F.transform(paths, _finding(PATHS, lambda m: F.lit("error")))))
    empty = F.array().cast("array<struct<what string, severity string, hint string>>")
    return rows.select(*[x for x in rows.columns if x != text], F.inline(F.concat(*[F.coalesce(x, empty) for x in told])))


def _finding(what: str, level):
    def one(m: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), level(m).alias("severity"), shown(m).alias("hint"))
    return one


def _not_neutral(path: Column) -> Column:
    out = F.lit(True)
    for root in NEUTRAL:
        out = out & (path != root) & ~path.startswith(root + "/")
    return out


def placeholders(rows: DataFrame, key: str, text: str = "text", pattern: str = ABSOLUTE, label: str = "PATH") -> DataFrame:
    """The text with each distinct match replaced by <LABEL_n>, numbered by first occurrence within the row.

    Longer matches are replaced first, so that one inside another does not break it.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    numbered = F.transform(found, lambda m, i: F.struct((-F.length(m)).alias("n"), i.alias("i"), m.alias("m")))
    replaced = F.aggregate(F.array_sort(numbered), F.col(text), lambda acc, s: F.replace(acc, s["m"], F.concat(F.lit(f"<{label}_"), (s["i"] + 1).cast("string"), F.lit(">"))))
    return rows.withColumn(text, F.when(F.col(text).isNotNull(), replaced))


#: The roots that stand for a project, for other paths (numbered) and for the home folder; text below them
#: is left alone. Shorter user names are replaced in paths only.
PROJECT, EXTERNAL, HOME, MIN_USER = "/home/dev/project", "/home/dev/external/p", "/home/dev", 3


def scrubbed(rows: DataFrame, home: str, project: str, text: str = "text") -> DataFrame:
    """The text with the project's root and the home folder replaced by stand-ins, other absolute paths numbered by first
    occurrence within the row, and the user's name replaced where it stands alone. Scrubbing again changes nothing.
    Either kind of slash separates, and in JSON text any number of backslashes does."""
    import re

    def root(path: str) -> str:
        path = path.strip().replace("\\", "/").rstrip("/")
        if not path.startswith("/") or path == "":
            raise ValueError("a root is an absolute path below /")
        return path
    home, project = root(home), root(project)
    anyslash = lambda p: r"(?:/|\\+)".join(re.escape(x) for x in p.split("/"))
    end = r"(?=$|[^A-Za-z0-9._-])"
    out = F.col(text)
    # stand-ins that are there already are kept apart while the rest is replaced
    kept = "\x01\ua66e"  # ends in a letter, so that what follows is no path of its own
    out = F.regexp_replace(out, HOME + end, kept)
    for path, stand_in in ((project, f"{kept}/project"), (home, kept)):
        out = F.regexp_replace(out, anyslash(path) + end, stand_in.replace("\\", "\\\\"))
    found = F.array_distinct(F.filter(F.regexp_extract_all(out, F.lit(BOUNDED), F.lit(0)), _not_neutral))
    numbered = F.transform(found, lambda m, i: F.struct((-F.length(m)).alias("n"), i.alias("i"), m.alias("m")))
    out = F.aggregate(F.array_sort(numbered), out, lambda acc, s: F.replace(acc, s["m"], F.concat(F.lit(f"{kept}/external/p"), s["i"].cast("string"))))
    user = home.rsplit("/", 1)[1]
    if len(user) >= MIN_USER and user != "dev":
        out = F.regexp_replace(out, rf"(?<![A-Za-z0-9]){re.escape(user)}(?![A-Za-z0-9])", "dev")
    return rows.withColumn(text, F.replace(out, F.lit(kept), F.lit(HOME)))
