"""Include and exclude globs, and minimum ages, as column expressions.

Patterns are parsed on the driver and become literals; no data is needed for it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.functions.paths import ancestors, depth, name

NS = 1_000_000_000
SECOND_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": NS, "sec": NS, "m": 60 * NS, "min": 60 * NS, "h": 3600 * NS, "hr": 3600 * NS, "d": 86400 * NS, "day": 86400 * NS, "w": 7 * 86400 * NS, "week": 7 * 86400 * NS, "M": 2_630_016 * NS, "month": 2_630_016 * NS, "y": 31_557_600 * NS, "year": 31_557_600 * NS}


def parse_duration(text: str) -> int:
    """Nanoseconds of '30d', '6M' (months), '6m' (minutes), '1h 30m', ..."""
    s = text.strip()
    if not s or not re.fullmatch(r"(?:\d+\s*[A-Za-z]+\s*)+", s):
        raise ValueError(f"not a duration: {text!r}")
    total = 0
    for n, unit in re.findall(r"(\d+)\s*([A-Za-z]+)", s):
        unit = unit if unit in SECOND_UNITS else unit.removesuffix("s")
        if unit not in SECOND_UNITS:
            raise ValueError(f"unknown unit {unit!r} in {text!r}")
        total += int(n) * SECOND_UNITS[unit]
    return total


def glob_regex(glob: str) -> str:
    """A Java (and DuckDB) regular expression for a whole path; `*` and `?` stay within one component."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == len(glob) or glob[i + 2] == "/"):
            if i + 2 == len(glob):
                out.append(".*")
                i += 2
            else:
                out.append("(?:.*/)?")
                i += 3
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = i + 1 + (glob[i + 1 : i + 2] in ("!", "^"))
            end = glob.find("]", j + 1)
            if end < 0:
                raise ValueError(f"unclosed class in {glob!r}")
            body = glob[j:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"(?!/)[{'^' if j > i + 1 else ''}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternation in {glob!r}")
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    text: str
    glob: str
    anchored: bool
    dir_only: bool

    @property
    def is_path(self) -> bool:
        return "/" in self.glob

    @property
    def literal_prefix(self) -> str:
        """Whole components before the first wildcard."""
        kept = []
        for part in self.glob.split("/"):
            if re.search(r"[*?\[{]", part):
                break
            kept.append(part)
        return "/".join(kept)


def parse_pattern(text: str) -> Pattern:
    body = text.strip("/") if text.strip("/") else ""
    if not body:
        raise ValueError(f"empty pattern {text!r}")
    glob_regex(body)
    anchored, dir_only = text.startswith("/"), text.endswith("/")
    return Pattern(text, text[int(anchored) : len(text) - int(dir_only)], anchored, dir_only)


@dataclass(frozen=True)
class FilterSettings:
    """Ordered patterns; excludes are asked first.  root_name: the base name by which the tree's root is asked too; without it the root is entered."""

    include: tuple[Pattern, ...] = ()
    exclude: tuple[Pattern, ...] = field(default=())
    root_name: str | None = None

    @classmethod
    def of(cls, include=(), exclude=(), root_name: str | None = None) -> FilterSettings:
        return cls(tuple(map(parse_pattern, include)), tuple(map(parse_pattern, exclude)), root_name)

    @classmethod
    def from_text(cls, text: str) -> FilterSettings:
        sides: dict[str, list[str]] = {"--include": [], "--exclude": []}
        for n, line in enumerate(text.splitlines(), 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            side, _, pattern = line.partition(" ")
            if side not in sides or not pattern.strip():
                raise ValueError(f"line {n}: expected --include PATTERN or --exclude PATTERN, found {line!r}")
            try:
                parse_pattern(pattern.strip())
            except ValueError as e:
                raise ValueError(f"line {n}: {e}") from e
            sides[side].append(pattern.strip())
        return cls.of(sides["--include"], sides["--exclude"])

    @classmethod
    def from_args(cls, include=(), exclude=(), text: str | None = None) -> FilterSettings:
        if text is not None and (include or exclude):
            raise ValueError("a filter file and inline patterns exclude each other")
        return cls.from_text(text) if text is not None else cls.of(include, exclude)

    @property
    def empty(self) -> bool:
        return not self.include and not self.exclude


def _any(conditions: list[Column]) -> Column:
    """An OR as a balanced tree: as a chain, a thousand of them are too deep for the planner."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def _by_name(pattern: Pattern) -> bool:
    """Whether a pattern asks for base names: a whole path that it matches has only one component."""
    return not pattern.anchored and not pattern.is_path


def _regex(pattern: Pattern) -> str:
    return f"(?s:{glob_regex(pattern.glob)})"


def matches(pattern: Pattern, path: Column, is_dir: Column) -> Column:
    """Anchored, or with a slash inside: the full path; else the base name."""
    of = name(path) if _by_name(pattern) else path
    hit = of.rlike(f"^{_regex(pattern)}$") if re.search(r"[*?\[{\\]", pattern.glob) else of == pattern.glob
    return hit & is_dir if pattern.dir_only else hit


#: Patterns that need a regular expression are searched this many at a time.
ALTERNATIVES = 64


def _literal(text: str) -> bool:
    return not re.search(r"[*?\[{\\]", text)


class _Matcher:
    """All patterns of a list as one question: what is literal is looked up in sets, by base name, its end or beginning, whole path, or first components; the rest is searched by alternations of regular expressions."""

    def __init__(self, patterns: tuple[Pattern, ...]):
        self.patterns = patterns
        #: Literals and the first pattern of each, by what is looked up, its length, and whether only directories count.
        self.sets: dict[tuple[str, int, bool], dict[str, int]] = {}
        self.rest: dict[tuple[bool, bool], list[int]] = {}
        for i, p in enumerate(patterns):
            for what, n, text in self._lookup(p):
                self.sets.setdefault((what, n, p.dir_only), {}).setdefault(text, i)
                break
            else:
                self.rest.setdefault((_by_name(p), p.dir_only), []).append(i)

    @staticmethod
    def _lookup(p: Pattern) -> list[tuple[str, int, str]]:
        g = p.glob
        if _literal(g):
            return [("name" if _by_name(p) else "path", 0, g)]
        if _by_name(p) and len(g) > 1 and g[0] == "*" and _literal(g[1:]):
            return [("end", len(g) - 1, g[1:])]
        if _by_name(p) and len(g) > 1 and g[-1] == "*" and _literal(g[:-1]):
            return [("begin", len(g) - 1, g[:-1])]
        if g.endswith("/**") and _literal(g[:-3]):
            return [("under", g.count("/"), g[:-3])]
        return []

    @staticmethod
    def _key(what: str, n: int, path: Column, base: Column) -> Column:
        if what in ("name", "path"):
            return base if what == "name" else path
        if what in ("end", "begin"):
            return F.right(base, F.lit(n)) if what == "end" else F.left(base, F.lit(n))
        return F.when(depth(path) > n, F.substring_index(path, "/", n))

    def _tests(self, path: Column, is_dir: Column) -> list[tuple[Column, Column]]:
        """(whether, first pattern) of each set and each alternation that may hold."""
        base, out = name(path), []
        only = lambda hit, dir_only: hit & is_dir if dir_only else hit
        for (what, n, dir_only), texts in self.sets.items():
            key = self._key(what, n, path, base)
            out.append((only(F.coalesce(key.isin(*texts), F.lit(False)), dir_only), F.element_at(F.from_json(F.lit(json.dumps(texts)), "map<string, int>"), key)))
        for (by_name, dir_only), indices in self.rest.items():
            of = base if by_name else path
            for k in range(0, len(indices), ALTERNATIVES):
                some = indices[k : k + ALTERNATIVES]
                each = [_regex(self.patterns[i]) for i in some]
                first = F.coalesce(*(F.when(of.rlike(f"^{r}$"), i) for r, i in zip(each, some)))
                out.append((only(of.rlike(f"^(?:{'|'.join(each)})$"), dir_only), first))
        return out

    def asked(self, path: Column, is_dir: Column) -> tuple[Column, Column]:
        """Whether a pattern matches, and the text of the first one that does, which is null where none does."""
        none, tests = F.lit(None).cast("int"), self._tests(path, is_dir)
        index = F.least(none, none, *(F.when(t, i) for t, i in tests))
        return _any([t for t, _ in tests]), F.element_at(F.from_json(F.lit(json.dumps([p.text for p in self.patterns])), "array<string>"), index + 1)

    def hit(self, path: Column, is_dir: Column) -> Column:
        return self.asked(path, is_dir)[0]

    def above(self, path: Column) -> Column:
        """Whether a directory above the path is matched."""
        out, folders = [], F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
        for (what, n, _), texts in self.sets.items():
            if what in ("name", "end", "begin"):
                out.append(F.exists(folders, lambda x: self._key(what, n, x, x).isin(*texts)))  # noqa: B023
                continue
            by_depth: dict[int, list[str]] = {}
            for t in texts:
                by_depth.setdefault(t.count("/") + 1, []).append(t)
            # A literal path is above what lies below it; what a/** matches is above that only from two components further.
            out += [(depth(path) > d + (what == "under")) & F.substring_index(path, "/", d).isin(*some) for d, some in by_depth.items()]
        for (by_name, _), indices in self.rest.items():
            for k in range(0, len(indices), ALTERNATIVES):
                each = "|".join(_regex(self.patterns[i]) for i in indices[k : k + ALTERNATIVES])
                out.append(path.rlike(f"{'(?:^|/)' if by_name else '^'}(?:{each})/"))
        return _any(out)


def excluded_above(settings: FilterSettings, path: Column) -> Column:
    """Whether an exclude matches a directory above the path."""
    return _Matcher(settings.exclude).above(path)


def enters_all(settings: FilterSettings) -> bool:
    """Whether some include may match anywhere, so that no directory is left out for what includes ask."""
    return any(_by_name(p) or not p.literal_prefix for p in settings.include)


def could_contain(settings: FilterSettings, path: Column) -> Column:
    """Whether a directory may hold something that an include matches."""
    if enters_all(settings):
        return F.lit(True)
    prefixes = {p.literal_prefix for p in settings.include}
    up = {prefix.rsplit("/", k)[0] for prefix in prefixes for k in range(prefix.count("/") + 1)}
    by_depth: dict[int, list[str]] = {}
    for prefix in sorted(prefixes):
        by_depth.setdefault(prefix.count("/") + 1, []).append(prefix)
    below = [(depth(path) > d) & F.substring_index(path, "/", d).isin(*some) for d, some in by_depth.items()]
    return _any([path.isin("", *sorted(up)), *below])


def directly_matches(settings: FilterSettings, path: Column, is_dir: Column) -> Column:
    """True without includes; else whether an include matches the entry itself."""
    return _Matcher(settings.include).hit(path, is_dir) if settings.include else F.lit(True)


def filter_result(settings: FilterSettings, path: Column, is_dir: Column) -> Column:
    """struct(status, pattern): included, excluded_by_default or excluded_by_pattern with the first pattern that matched."""
    row = lambda status, pattern=F.lit(None).cast("string"): F.struct(F.lit(status).alias("status"), pattern.alias("pattern"))
    hit = directly_matches(settings, path, is_dir) | (is_dir & could_contain(settings, path))
    out = F.when(hit, row("included")).otherwise(row("excluded_by_default")) if settings.include else row("included")
    if settings.exclude:
        hit, first = _Matcher(settings.exclude).asked(path, is_dir)
        out = F.when(hit, row("excluded_by_pattern", first)).otherwise(out)
    return out


def is_included(settings: FilterSettings, path: Column, is_dir: Column) -> Column:
    if settings.empty:
        return F.lit(True)
    return ~_Matcher(settings.exclude).hit(path, is_dir) & (directly_matches(settings, path, is_dir) | (is_dir & could_contain(settings, path)))


def root_included(settings: FilterSettings, root_name: str, kind: str = "dir") -> bool:
    """Whether the root is entered: by base name, anchored and path patterns aside; a root directory is always entered when there are includes."""

    def hit(p: Pattern) -> bool:
        return not p.anchored and not p.is_path and (kind == "dir" or not p.dir_only) and re.fullmatch(glob_regex(p.glob), root_name) is not None

    if any(map(hit, settings.exclude)):
        return False
    return not settings.include or kind == "dir" or any(map(hit, settings.include))


def apply_filter(m: DataFrame, settings: FilterSettings | None) -> DataFrame:
    """m with walk (included, skipped, pruned) and reason: what a walk that does not enter excluded directories meets.

    Row-local: every ancestor of a row is a directory, so its verdict follows from its path.
    """
    if settings is None or settings.empty:
        return m.withColumns({"walk": F.lit("included"), "reason": F.lit(None).cast("string")})
    path, is_dir = F.col("rel_path"), F.col("kind") == "dir"
    pruned = excluded_above(settings, path)
    if settings.include and not enters_all(settings):
        left_out = lambda a: (a != "") & ~(directly_matches(settings, a, F.lit(True)) | could_contain(settings, a))
        pruned = pruned | F.exists(ancestors(path), left_out)
    root = F.lit("included")
    if settings.root_name is not None:
        entered = {kind: root_included(settings, settings.root_name, kind) for kind in ("dir", "file")}
        if not entered["dir"]:
            pruned = path != ""
        root = F.when(is_dir, F.lit("included" if entered["dir"] else "root")).otherwise(F.lit("included" if entered["file"] else "root"))
    verdict = F.when(path == "", F.struct(root.alias("status"), F.lit(None).cast("string").alias("pattern"))).otherwise(filter_result(settings, path, is_dir))
    out = m.withColumns({"_pruned": pruned, "_verdict": verdict})
    walk = F.when(F.col("_pruned"), "pruned").when(F.col("_verdict.status") == "included", "included").otherwise("skipped")
    reason = F.when(walk == "skipped", F.coalesce("_verdict.pattern", F.when(path == "", "the root's name").otherwise("no include matches")))
    return out.withColumns({"walk": walk, "reason": reason}).drop("_pruned", "_verdict")


def time_filter(modified_before: str | int | None, created_before: str | int | None, now_s: int, now_ns: int = 0) -> Column:
    """matched, too_new_modified, too_new_created or too_new_both.  Ages are minimum ages, the boundary counts, null or future times are too new."""

    def old(seconds: str, nanos: str, age: str | int | None) -> Column:
        if age is None:
            return F.lit(True)
        limit = now_s * NS + now_ns - (parse_duration(age) if isinstance(age, str) else age)
        s, ns = F.col(seconds), F.coalesce(F.col(nanos), F.lit(0))
        return F.coalesce((s < limit // NS) | ((s == limit // NS) & (ns <= limit % NS)), F.lit(False))

    m, c = old("mtime_s", "mtime_ns", modified_before), old("btime_s", "btime_ns", created_before)
    return F.when(m & c, "matched").when(~m & ~c, "too_new_both").when(~m, "too_new_modified").otherwise("too_new_created")
