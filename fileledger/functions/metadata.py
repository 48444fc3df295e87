"""Comparison and projection of entry metadata, and mode programs, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ("uid", "gid", "mode", "size", "mtime", "ctime")
KIND_LETTERS = {"f": "file", "d": "dir", "l": "symlink", "o": "other"}
DEFAULT_COMPARE = "f:mtime,size d:mtime l:mtime"


def parse_metadata_cmp(text: str) -> frozenset[str]:
    """'size,mtime' -> attributes; empty text compares nothing."""
    found = [a.strip() for a in text.split(",") if a.strip()]
    if bad := [a for a in found if a not in ATTRIBUTES]:
        raise ValueError(f"unknown attribute {bad[0]!r}")
    return frozenset(found)


def parse_compare(text: str) -> dict[str, frozenset[str]]:
    """'f:mtime,size d:mtime l:mtime' -> attributes by kind; kinds not named compare nothing."""
    out: dict[str, frozenset[str]] = {}
    for part in text.split():
        letter, colon, attrs = part.partition(":")
        if not colon or letter not in KIND_LETTERS:
            raise ValueError(f"expected kind:attributes, found {part!r}")
        if KIND_LETTERS[letter] in out:
            raise ValueError(f"{letter!r} is given twice")
        out[KIND_LETTERS[letter]] = parse_metadata_cmp(attrs)
    return out


def metadata_equal(attributes: frozenset[str], a: str, b: str) -> Column:
    """Prefixes a and b name the two sides' columns.

    Seconds of mtime must agree and nanoseconds only where neither is zero; ctime
    counts only where neither side's seconds are zero (zero: not available).
    """
    out = F.lit(True)
    at = lambda side, n: F.coalesce(F.col(f"{side}{n}"), F.lit(0))
    for n in ("uid", "gid", "mode", "size"):
        if n in attributes:
            out = out & (at(a, n) == at(b, n))
    nanos = lambda n: (at(a, n) == 0) | (at(b, n) == 0) | (at(a, n) == at(b, n))
    if "mtime" in attributes:
        out = out & (at(a, "mtime_s") == at(b, "mtime_s")) & nanos("mtime_ns")
    if "ctime" in attributes:
        out = out & ((at(a, "ctime_s") == 0) | (at(b, "ctime_s") == 0) | ((at(a, "ctime_s") == at(b, "ctime_s")) & nanos("ctime_ns")))
    return out


def equal_by_kind(compare: dict[str, frozenset[str]], kind: Column, a: str, b: str) -> Column:
    out = F.lit(True)
    for k, attributes in compare.items():
        out = F.when(kind == k, metadata_equal(attributes, a, b)).otherwise(out)
    return out


def dest_is_newer(a: str, b: str) -> Column:
    """Whether b's (seconds, nanoseconds) come strictly after a's."""
    return (F.col(f"{b}mtime_s") > F.col(f"{a}mtime_s")) | ((F.col(f"{b}mtime_s") == F.col(f"{a}mtime_s")) & (F.coalesce(f"{b}mtime_ns", F.lit(0)) > F.coalesce(f"{a}mtime_ns", F.lit(0))))


def skip_unchanged(attributes: frozenset[str], a: str, b: str, ignore_existing: bool = False, keep_newer: bool = False) -> Column:
    """Whether a file need not be sent, given the destination's row (all null: none)."""
    there = F.col(f"{b}kind").isNotNull()
    out = F.when(~there, False)
    if ignore_existing:
        out = out.when(there, True)
    out = out.when(F.col(f"{b}kind") != "file", False).when(metadata_equal(attributes, a, b), True)
    return (out.when(dest_is_newer(a, b), True) if keep_newer else out).otherwise(False)


def same_type(a: str, b: str) -> Column:
    return F.col(f"{a}kind") == F.col(f"{b}kind")


def masked_mode(mode: Column, mask: int = 0o7777) -> Column:
    return mode.bitwiseAND(0o7777) if mask == 0o7777 else mode.bitwiseAND(0o7777).bitwiseAND(mask)


def iops_tokens(size: Column, chunk: int) -> Column:
    """Tokens that a file of this size costs: null for chunk 0, else 1 and one more for each further chunk."""
    return F.lit(None).cast("bigint") if chunk == 0 else F.floor((F.greatest(F.lit(1), size) - 1) / chunk).cast("bigint") + 1


#: Tokens that a file may cost at most to be throttled.
MOST_TOKENS = (1 << 32) - 1


def tokens_beyond(tokens: Column) -> Column:
    """Whether a file costs more tokens than can be taken at once: the chunk is too small for it."""
    return F.coalesce(tokens > MOST_TOKENS, F.lit(False))


@dataclass(frozen=True)
class PreserveKind:
    uid: bool = False
    gid: bool = False
    time: bool = False
    mask: int = 0o777
    acl: bool = False


@dataclass(frozen=True)
class Preserve:
    file: PreserveKind = PreserveKind()
    dir: PreserveKind = PreserveKind()
    symlink: PreserveKind = PreserveKind()

    def of(self, kind: str) -> PreserveKind:
        return getattr(self, kind, PreserveKind())


def parse_preserve(text: str) -> Preserve:
    """'all', 'none', 'all+acl', or kinds as in 'f:uid,gid,time,0777 d:uid l:time'; an octal number is the mode mask."""
    base, plus, extra = text.strip().partition("+")
    if base in ("all", "none") and (not plus or extra == "acl"):
        if base == "none" and plus:
            return Preserve(PreserveKind(mask=0o7777, acl=True), PreserveKind(mask=0o7777, acl=True))
        full = PreserveKind(True, True, True, 0o7777, bool(plus))
        return Preserve(full, full, PreserveKind(True, True, True, 0o7777)) if base == "all" else Preserve()
    kinds: dict[str, PreserveKind] = {}
    for part in text.split():
        letter, colon, attrs = part.partition(":")
        if not colon or letter not in "fdl":
            raise ValueError(f"expected kind:attributes, found {part!r}")
        values: dict = {}
        for a in filter(None, attrs.split(",")):
            if a in ("uid", "gid", "time", "acl"):
                values[a] = True
            elif re.fullmatch(r"[0-7]{3,4}", a):
                values["mask"] = int(a, 8)
            else:
                raise ValueError(f"unknown attribute {a!r}")
        if values.get("acl"):
            if letter == "l":
                raise ValueError("symbolic links have no ACL")
            if values.setdefault("mask", 0o7777) & 0o777 != 0o777:
                raise ValueError("an ACL needs a mask that keeps all permission bits")
        kinds[KIND_LETTERS[letter]] = PreserveKind(**values)
    return Preserve(**kinds)


def validate_update_compare(compare: frozenset[str], preserve: Preserve) -> list[str]:
    """Compared attributes that copies of files will not have, so that the next run would copy them again."""
    p = preserve.file
    kept = {"uid": p.uid, "gid": p.gid, "mtime": p.time, "ctime": False, "mode": p.mask == 0o7777, "size": True}
    return sorted(a for a in compare if not kept[a])


def project_preserved(m: DataFrame, preserve: Preserve, uid: int = 0, gid: int = 0, now_s: int = 0) -> DataFrame:
    """m with the ids, times and mode its copy gets: the source's where preserved, else those given."""

    def pick(name: str, flag: str, other: Column) -> Column:
        out = other
        for kind in ("file", "dir", "symlink"):
            if getattr(preserve.of(kind), flag):
                out = F.when(F.col("kind") == kind, F.col(name)).otherwise(out)
        return out

    mode = masked_mode(F.col("mode"), PreserveKind().mask)
    for kind in ("file", "dir", "symlink"):
        mode = F.when(F.col("kind") == kind, masked_mode(F.col("mode"), preserve.of(kind).mask)).otherwise(mode)
    acl = {"acl": pick("acl", "acl", F.lit(None).cast(m.schema["acl"].dataType))} if "acl" in m.columns else {}
    return m.withColumns({"uid": pick("uid", "uid", F.lit(uid).cast("bigint")), "gid": pick("gid", "gid", F.lit(gid).cast("bigint")), "mtime_s": pick("mtime_s", "time", F.lit(now_s).cast("bigint")), "mtime_ns": pick("mtime_ns", "time", F.lit(0)), "mode": mode, **acl})


@dataclass(frozen=True)
class Clause:
    who: str
    op: str
    perms: str


def parse_octal(text: str) -> int:
    if not re.fullmatch(r"[0-7]{1,5}", text) or int(text, 8) > 0o7777:
        raise ValueError(f"not an octal mode: {text!r}")
    return int(text, 8)


def parse_mode(text: str) -> int | tuple[Clause, ...]:
    """An octal mode, or clauses as in 'u=rwx,go+rX'."""
    if text[:1].isdigit():
        return parse_octal(text)
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"([ugoa]*)((?:[+=-][rwxXst]*)+)", part)
        if not m:
            raise ValueError(f"not a mode clause: {part!r}")
        out += [Clause(m[1] or "a", op, perms) for op, perms in re.findall(r"([+=-])([rwxXst]*)", m[2])]
    return tuple(out)


def parse_mode_dsl(text: str) -> dict[str, int | tuple[Clause, ...]]:
    """A bare mode for files and directories, 'f:' and 'd:' modes for one of them; one bare mode at most."""
    out: dict[str, int | tuple[Clause, ...]] = {}
    bare = None
    for part in text.split():
        letter, colon, mode = part.partition(":")
        if colon and letter in "fd":
            if KIND_LETTERS[letter] in out:
                raise ValueError(f"{letter!r} is given twice")
            out[KIND_LETTERS[letter]] = parse_mode(mode)
        elif bare is not None:
            raise ValueError("more than one bare mode")
        else:
            bare = parse_mode(part)
    for kind in ("file", "dir"):
        if bare is not None:
            out.setdefault(kind, bare)
    return out


def parse_owner_dsl(text: str, names: dict[str, int] | None = None) -> dict[str, int]:
    """'1000', 'alice', 'f:1000 d:0': id by kind; a bare id is for all kinds not named."""
    out: dict[str, int] = {}
    bare = None
    for part in text.split():
        letter, colon, value = part.partition(":")
        if not colon:
            letter, value = "", part
        if value.isdigit():
            n = int(value)
        elif names and value in names:
            n = names[value]
        else:
            raise ValueError(f"unknown owner {value!r}")
        if letter:
            if letter not in "fdl" or KIND_LETTERS[letter] in out:
                raise ValueError(f"bad or repeated kind in {part!r}")
            out[KIND_LETTERS[letter]] = n
        elif bare is not None:
            raise ValueError("more than one bare owner")
        else:
            bare = n
    for kind in ("file", "dir", "symlink", "other"):
        if bare is not None:
            out.setdefault(kind, bare)
    return out


_READ, _WRITE, _EXEC = {"u": 0o400, "g": 0o040, "o": 0o004}, {"u": 0o200, "g": 0o020, "o": 0o002}, {"u": 0o100, "g": 0o010, "o": 0o001}
_SPECIAL = {"u": 0o4000, "g": 0o2000, "o": 0o1000}


def apply_mode(mode: Column, spec: int | tuple[Clause, ...], is_dir: Column) -> Column:
    """The permission bits after an octal mode or after each clause in turn.

    X: execute for directories or where any execute bit is set by then; s: set-id
    of user and group; t: sticky, of others; =: clears all bits of the named first.
    """
    if isinstance(spec, int):
        return F.lit(spec)
    out = mode.bitwiseAND(0o7777)
    for c in spec:
        who = "ugo" if "a" in c.who else c.who
        bits, when_exec, clear = 0, 0, 0
        for w in dict.fromkeys(who):
            clear |= _READ[w] | _WRITE[w] | _EXEC[w] | _SPECIAL[w]
            bits |= ("r" in c.perms) * _READ[w] | ("w" in c.perms) * _WRITE[w] | ("x" in c.perms) * _EXEC[w]
            bits |= ("s" in c.perms and w in "ug" or "t" in c.perms and w == "o") * _SPECIAL[w]
            when_exec |= ("X" in c.perms) * _EXEC[w]
        add = F.when(is_dir | (out.bitwiseAND(0o111) != 0), F.lit(bits | when_exec)).otherwise(F.lit(bits)) if when_exec else F.lit(bits)
        if c.op == "+":
            out = out.bitwiseOR(add)
        elif c.op == "-":
            out = out.bitwiseAND(F.bitwise_not(add))
        else:
            out = out.bitwiseAND(0o7777 & ~clear).bitwiseOR(add)
    return out
