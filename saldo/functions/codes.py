"""Algebra of product and activity codes: what a code covers, tilings, splits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections of the activity classification and their divisions. Fixed values.
SECTIONS = {
    "A": (1, 3), "B": (5, 9), "C": (10, 33), "D": (35, 35), "E": (36, 39), "F": (41, 43), "G": (45, 47), "H": (49, 53), "I": (55, 56), "J": (58, 63), "K": (64, 66),
    "L": (68, 68), "M": (69, 75), "N": (77, 82), "O": (84, 84), "P": (85, 85), "Q": (86, 88), "R": (90, 93), "S": (94, 96), "T": (97, 98), "U": (99, 99),
}
_prefix = re.compile(r"^CPA(2_1)?_")


def bare(code: str) -> str:
    """The code without its product-classification prefix."""
    return _prefix.sub("", code)


def covered(code: str) -> frozenset[str]:
    """Divisions a code stands for, as letter and two digits, with a suffix where it is part of one (L68A); empty if unknown."""
    out: set[str] = set()
    text = bare(code)
    if m := re.fullmatch(r"([A-U])-([A-U])", text):
        letters = [c for c in SECTIONS if m[1] <= c <= m[2]]
    else:
        letters = [c for c in text.split("_") if c in SECTIONS] if re.fullmatch(r"[A-U](_[A-U])*", text) else []
    for c in letters:
        lo, hi = SECTIONS[c]
        out |= {f"{c}{n:02d}" for n in range(lo, hi + 1)}
    if letters:
        return frozenset(out)
    for part in text.split("_"):
        if m := re.fullmatch(r"([A-U])(\d\d)-(?:[A-U])?(\d\d)", part):
            out |= {f"{m[1]}{n:02d}" for n in range(int(m[2]), int(m[3]) + 1)}
        elif re.fullmatch(r"[A-U]\d\d[A-Z]?", part):
            out.add(part)
        elif (m := re.fullmatch(r"(\d\d)", part)) and out:
            out.add(sorted(out)[0][0] + m[1])
        else:
            return frozenset()
    return frozenset(out)


def covers(a: str, b: str) -> bool:
    """Whether a stands for all of b and more."""
    big, small = covered(a), covered(b)
    if not big or not small or big == small:
        return False
    return all(c in big or c[:3] in big for c in small)


def coarsest(codes: list[str]) -> list[str]:
    """Codes that no other code covers, in the order given."""
    return [c for c in codes if not any(covers(o, c) for o in codes)]


def finest(codes: list[str], totals: dict[str, float], tol: float) -> tuple[list[str], list[str]]:
    """Replace each parent by its children where their totals are all known and add up to it; else drop the children. With notes."""
    kept, notes = list(codes), []
    for parent in sorted(codes, key=lambda c: (-len(covered(c)), c)):
        inside = [c for c in kept if covers(parent, c)]
        kids = [c for c in inside if not any(covers(o, c) for o in inside)]
        if parent not in kept or not kids:
            continue
        if any(totals.get(c) is None for c in [parent, *kids]):
            notes.append(f"{parent}: a total is missing, so its parts {', '.join(kids)} are not used")
            kept = [c for c in kept if c not in inside]
        elif abs(sum(totals[c] for c in kids) - totals[parent]) <= tol * (len(kids) + 1):
            kept.remove(parent)
        else:
            notes.append(f"{parent}: its parts add up to {sum(totals[c] for c in kids):g}, not {totals[parent]:g}")
            kept = [c for c in kept if c not in inside]
    return kept, notes


def prefix_tiling(codes: DataFrame) -> DataFrame:
    """Codes of which no other code is a proper prefix. The join is on cut codes, not on all pairs."""
    cuts = codes.select("code", F.explode(F.sequence(F.lit(1), F.greatest(F.length("code") - 1, F.lit(1)))).alias("n")).where("n < length(code)").select("code", F.substring("code", F.lit(1), F.col("n")).alias("head"))
    inside = cuts.join(codes.select(F.col("code").alias("head")), "head", "left_semi").select("code").distinct()
    return codes.join(inside, "code", "left_anti")


def code_cover(codes: DataFrame) -> DataFrame:
    """(code, division) for codes such as C10-12, C31_32, L68A or a letter; built from column expressions."""
    text = F.regexp_replace("code", r"^CPA(2_1)?_", "")
    section = F.map_from_arrays(F.array(*[F.lit(s) for s in SECTIONS]), F.array(*[F.array(*[F.lit(f"{s}{n:02d}") for n in range(lo, hi + 1)]) for s, (lo, hi) in SECTIONS.items()]))
    letter, first, last = (F.regexp_extract(text, r"^([A-U])(\d\d)[-_](?:[A-U])?(\d\d)$", k) for k in (1, 2, 3))
    ends = F.when(text.contains("-"), F.sequence(first.try_cast("int"), last.try_cast("int"))).otherwise(F.array(first.try_cast("int"), last.try_cast("int")))
    span = F.transform(ends, lambda n: F.concat(letter, F.lpad(n.cast("string"), 2, "0")))
    out = F.when(text.rlike(r"^[A-U]$"), F.element_at(section, text)).when(text.rlike(r"^[A-U]\d\d[-_](?:[A-U])?\d\d$"), span).when(text.rlike(r"^[A-U]\d\d[A-Z]?$"), F.array(text))
    return codes.select("code", F.explode(out).alias("division"))


def coarsest_tiling(codes: DataFrame) -> DataFrame:
    """Codes that no other covers: their divisions are matched in an equi-join and counted, not compared pair by pair."""
    cover = code_cover(codes.select("code").distinct())
    size = cover.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    small = cover.withColumn("division", F.substring("division", 1, 3))
    shared = small.join(cover.withColumnRenamed("code", "other"), "division").where("code <> other").groupBy("code", "other").agg(F.count(F.lit(1)).alias("m"))
    inside = shared.join(size, "code").join(size.select(F.col("code").alias("other"), F.col("n").alias("on")), "other")
    suffix = F.col("code").rlike("[0-9][A-Z]$") & ~F.col("other").rlike("[0-9][A-Z]$")
    gone = inside.where((F.col("m") == F.col("n")) & ((F.col("on") > F.col("n")) | suffix)).select("code").distinct()
    return codes.join(gone, "code", "left_anti")


def split_problems(parent: str, children: list[str]) -> list[str]:
    """What is wrong with splitting a numeric code into children; codes without digits pass unchecked."""
    digits = lambda c: re.sub(r"\D", "", c)
    base = digits(parent)
    if not base:
        return []
    out = []
    if len(set(children)) < len(children):
        out.append("a child repeats")
    if len(children) > 9:
        out.append("more than nine children")
    if len(base) >= 5:
        out.append(f"{parent} is at the deepest level")
    out += [f"{c} is not {parent} and one more digit" for c in children if digits(c) and not re.fullmatch(re.escape(base) + r"\d", digits(c))]
    return out


def expand_label(label: str) -> tuple[list[str], list[str]] | None:
    """Codes that an office's label covers and excludes: "C1101T1106 & C12", "C20_21", "A.1-3", "C10X107"; None if unreadable."""
    inside, outside = [], []
    for part in re.split(r"\s*&\s*", label.strip()):
        head, *gone = part.split("X")
        if m := re.fullmatch(r"([A-Z])(\d+)T(?:[A-Z])?(\d+)", head):
            inside += [f"{m[1]}{n:0{len(m[2])}d}" for n in range(int(m[2]), int(m[3]) + 1)]
        elif m := re.fullmatch(r"([A-Z])(\d+)(?:_(\d+))+", head):
            inside += [m[1] + d for d in re.findall(r"\d+", head)]
        elif m := re.fullmatch(r"([A-Z]?\d+)\.(\d)-(\d)", head):
            inside += [f"{m[1]}.{n}" for n in range(int(m[2]), int(m[3]) + 1)]
        elif re.fullmatch(r"[A-Z]?\d+(\.\d+)?|[A-Z]", head):
            inside.append(head)
        else:
            return None
        outside += [head[:1] + g if head[:1].isalpha() and not g[:1].isalpha() else g for g in gone]
    return inside, outside


def find(target: str, sources: list[dict]) -> list[tuple[str, str, str | None]]:
    """(source, verdict, holder): SEPARATE where live, PUBLISHED_NOT_LOADED, INSIDE the finest holder, or ABSENT."""
    out = []
    for s in sources:
        holders = sorted((c for c in s["codes"] if covers(c, target)), key=lambda c: (len(covered(c)), c))
        if target in s["codes"]:
            out.append((s["id"], "SEPARATE", target))
        elif target in s.get("published", ()):
            out.append((s["id"], "PUBLISHED_NOT_LOADED", target))
        else:
            out.append((s["id"], "INSIDE", holders[0]) if holders else (s["id"], "ABSENT", None))
    return out


def advise(target: str, sources: list[dict]) -> dict:
    """What to do to get a code on its own: load it, ask its publisher, split its finest holder, or nothing."""
    found = find(target, sources)
    size = {s["id"]: len(s["codes"]) for s in sources}
    for verdict, action in (("SEPARATE", "load"), ("PUBLISHED_NOT_LOADED", "publisher_has_it"), ("INSIDE", "split")):
        some = sorted((f for f in found if f[1] == verdict), key=lambda f: (-size[f[0]], f[0]))
        if some:
            return {"action": action, "source": some[0][0], "code": some[0][2]}
    return {"action": "none", "source": None, "code": None}
