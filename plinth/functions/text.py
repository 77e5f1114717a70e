"""Column expressions on names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEEPEST_BASEMENT, LEVEL_CODES, REGIONS, SHAPE_CODES, TOP_STOREY

#: Fixed values: (pattern, class) of file names, the first match counts.
FILENAME_RULES = [
    ("PERSPECTIVE", "DISCARD"),
    (r"-S-\d{3}-.*-00$", "STRUCT_PLAN_OVERALL"),
    (r"-S-\d{3}-.*-0[1-4]$", "STRUCT_PLAN_ENLARGED"),
    ("SECTION", "SECTION"),
    ("ELEVATION", "ELEVATION"),
]
#: Patterns of labels, level names, levels and thickness notes.
TYPE_PATTERN = r"^(H-)?[A-Z]{1,3}\d+[A-Z]?$"
RECT_PATTERN = r"^(\d{3,4})\s*[xX]\s*(\d{3,4})$"
DIA_PATTERN = r"^[ØøD]\s*(\d{3,4})$|^(\d{3,4})\s*(?:DIA|dia|Ø|ø)$"
LEVEL_PATTERN = r"^(?:BASEMENT\s+\d+|\d+(?:ST|ND|RD|TH)\s+STOREY|B\d+|L\d+|RF|UR|MEZZ|GF|GL|ROOF|PARAPET)\b"
FFL_PATTERN = r"(?i)FFL\s*([+\-])\s*(\d+(?:\.\d+)?)"
RL_PATTERN = r"^([+\-])?\s*(\d{2,5}(?:\.\d+)?)\s*(mm|m|MM|M)?$"
STOREY_PATTERN, BASEMENT_PATTERN = r"^([1-9]\d?)(ST|ND|RD|TH) STOREY$", r"^BASEMENT (\d)$"
CODE_PATTERN = r"^(L[1-9]\d?|B\d)$"
THICKNESS_PATTERN = r"(?i)(?:^|\s)(?:T\s*=\s*)?\d{2,4}\s*(?:SLAB|THK|THICK|DEEP|MM)\b|^T\s*=\s*\d{2,4}$"

#: Patterns of storeys, pages and sections in file names, of a section's cut line, and of a judge's reply.
STOREY_ID_PATTERN = r"(?i)-(B\d|L\d+|RF|UR|MEZZ|GF|GL)-0[0-4]\b"
PAGE_PATTERN = r"(?i)-(?:B\d|L\d+|RF|UR|MEZZ|GF|GL)-0([1-4])\b"
SECTIONS_PATTERN = r"(?i)_SECTION\s+([A-Z]+(?:_[A-Z]+)*)"
CUT_LINE_PATTERN = r"\bSECTION\s+[A-Z]\s*[-–]\s*[A-Z]\b"
REPLY_CLASS, REPLY_CONFIDENCE, REPLY_REASON = r"(?i)CLASS:\s*([A-Z_]+)", r"(?i)CONFIDENCE:\s*([\d.]+)", r"(?is)REASON:\s*(.+)"
#: Words of title blocks and the class each stands for, the first found counts.
TITLE_WORDS = [("PERSPECTIVE", "DISCARD"), ("SECTION", "SECTION"), ("ELEVATION", "ELEVATION")]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """Null for the empty string, which regexp_extract gives for no match."""
    return F.nullif(text, F.lit(""))


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first rule whose pattern is found, ignoring case; else null."""
    out = None
    for pattern, value in rules:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("string") if out is None else out


def rules_from_config(rules: list[tuple[str, str]] | None, classes: tuple[str, ...]) -> list[tuple[str, str]]:
    """Own rules replace the default ones; unknown classes drop out, and if none is left the defaults hold."""
    known = [(p, c) for p, c in rules or [] if c in classes]
    return known or FILENAME_RULES


def storey_id(stem: Column) -> Column:
    found = filled(F.regexp_extract(stem, STOREY_ID_PATTERN, 1))
    return F.coalesce(F.upper(found), stem)


def page_number(stem: Column) -> Column:
    found = filled(F.regexp_extract(stem, PAGE_PATTERN, 1))
    return F.coalesce(found.cast("int"), F.lit(0))


def page_region(number: Column) -> Column:
    regions = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(regions, number), F.lit("unknown"))


def section_ids(stem: Column) -> Column:
    found = F.upper(F.regexp_extract(stem, SECTIONS_PATTERN, 1))
    return F.filter(F.split(found, "_"), lambda x: x != "")


def direction_degrees(dx: Column, dy: Column) -> Column:
    # straight left is -180, which Spark's atan2, dropping the sign of -0.0, would turn
    angle = F.when((dy == 0) & (dx < 0), -180.0).otherwise(F.degrees(F.atan2(-dy, dx)))
    return F.coalesce(F.bround(angle, 1), F.lit(0.0))


def label_kind(text: Column) -> Column:
    return F.when(text.rlike(TYPE_PATTERN), "type").when(text.rlike(RECT_PATTERN), "rect_dim").when(text.rlike(DIA_PATTERN), "diameter").otherwise("other")


def label_parts(text: Column) -> dict[str, Column]:
    """kind, is_steel, rect_a, rect_b, diameter of a label text."""
    kind = label_kind(text)
    rect = [F.when(kind == "rect_dim", F.regexp_extract(text, RECT_PATTERN, i).cast("int")) for i in (1, 2)]
    dia = F.coalesce(filled(F.regexp_extract(text, DIA_PATTERN, 1)), filled(F.regexp_extract(text, DIA_PATTERN, 2)))
    return {
        "kind": kind,
        "is_steel": (kind == "type") & text.startswith("H-"),
        "rect_a": rect[0],
        "rect_b": rect[1],
        "diameter": F.when(kind == "diameter", dia.cast("int")),
    }


def level_name(text: Column) -> Column:
    return filled(F.regexp_extract(F.upper(strip(text)), LEVEL_PATTERN, 0))


def level_mm(text: Column) -> Column:
    """struct(rl_mm, source): FFL metres anywhere, else a bare number in range; half to even."""
    sign = lambda c: F.when(c == "-", -1.0).otherwise(1.0)
    metres = filled(F.regexp_extract(text, FFL_PATTERN, 2)).cast("double")
    ffl = F.bround(sign(F.regexp_extract(text, FFL_PATTERN, 1)) * metres * 1000.0, 0).cast("int")
    bare = strip(text)
    value = filled(F.regexp_extract(bare, RL_PATTERN, 2)).cast("double")
    unit = F.when(F.lower(F.regexp_extract(bare, RL_PATTERN, 3)) == "m", 1000.0).otherwise(1.0)
    plain = F.bround(sign(F.regexp_extract(bare, RL_PATTERN, 1)) * value * unit, 0).cast("int")
    return F.when(ffl.isNotNull(), F.struct(ffl.alias("rl_mm"), F.lit("FFL").alias("source"))).when(
        plain.between(-50000, 200000), F.struct(plain.alias("rl_mm"), F.lit("MM").alias("source"))
    )


def judge_reply(raw: Column, classes: tuple[str, ...]) -> Column:
    """struct(class, confidence, reason), null for an unknown or missing class."""
    cls = F.upper(filled(F.regexp_extract(raw, REPLY_CLASS, 1)))
    confidence = filled(F.regexp_extract(raw, REPLY_CONFIDENCE, 1)).try_cast("double")
    reason = strip(F.split(filled(F.regexp_extract(raw, REPLY_REASON, 1)), "\n")[0])
    return F.when(cls.isin(*classes), F.struct(cls.alias("class"), confidence.alias("confidence"), reason.alias("reason")))


def title_class(text: Column) -> Column:
    upper = F.upper(text)
    out = None
    for word, cls in TITLE_WORDS:
        hit = upper.rlike(rf"\b{word}\b")
        out = F.when(hit, cls) if out is None else out.when(hit, cls)
    return out


def is_cut_line(text: Column) -> Column:
    return F.upper(text).rlike(CUT_LINE_PATTERN)


def level_code(name: Column) -> Column:
    """The short code of a level's usual name, or of a code in any case; else null."""
    upper = F.upper(strip(name))
    number = F.regexp_extract(upper, STOREY_PATTERN, 1).try_cast("int")
    last = F.when((number / 10).cast("int") == 1, 0).otherwise(number % 10)
    ending = F.when(last == 1, "ST").when(last == 2, "ND").when(last == 3, "RD").otherwise("TH")
    storey = F.when((number <= TOP_STOREY) & (F.regexp_extract(upper, STOREY_PATTERN, 2) == ending), F.concat(F.lit("L"), number.cast("string")))
    below = F.regexp_extract(upper, BASEMENT_PATTERN, 1).try_cast("int")
    basement = F.when(below.between(1, DEEPEST_BASEMENT), F.concat(F.lit("B"), below.cast("string")))
    code = filled(F.regexp_extract(upper, CODE_PATTERN, 1))
    deep = F.when(code.startswith("B"), DEEPEST_BASEMENT).otherwise(TOP_STOREY)
    numbered = F.when(F.substring(code, 2, 2).try_cast("int").between(1, deep), code)
    named = F.create_map(*[F.lit(x) for k, v in LEVEL_CODES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(named, upper), storey, basement, numbered, F.when(upper.isin(*sorted(set(LEVEL_CODES.values()))), upper))


def resolve_alias(name: Column, own: dict[str, str] | None = None) -> Column:
    """Code of a level name by one's own aliases, else the usual ones, ignoring case and outer blanks; other names pass through."""
    code = level_code(name)
    if own:
        table = {v.upper(): v for v in own.values()} | {k.strip().upper(): v for k, v in own.items()}
        entries = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
        code = F.coalesce(F.try_element_at(entries, F.upper(strip(name))), code)
    return F.coalesce(code, name)


def type_name(label: Column, shape: Column, dim_x: Column, dim_y: Column, diameter: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in SHAPE_CODES.items() for x in pair])
    code = F.coalesce(F.try_element_at(codes, shape), F.lit("X"))
    text = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("string")
    size = F.when(shape == "round", text(diameter)).when(shape == "square", text(dim_x)).otherwise(F.concat(text(dim_x), F.lit("x"), text(dim_y)))
    return F.concat_ws("_", F.upper(strip(F.coalesce(filled(label), F.lit("UNLABELED")))), code, size)


def rejection(shape: Column, dim_x: Column, dim_y: Column, diameter: Column) -> Column:
    """Why a column can't be typed, or null."""
    return (
        F.when(shape.isin("L", "T"), F.concat(F.lit("shape_"), shape, F.lit("_deferred")))
        .when(shape.isNull() | shape.isin("", "unknown"), "shape_unknown")
        .when((shape == "round") & diameter.isNull(), "diameter_missing")
        .when((shape != "round") & (dim_x.isNull() | dim_y.isNull()), "dims_missing")
    )


def safe_file_name(name: Column) -> Column:
    """Only word characters and hyphens, runs of other ones as one underscore, none outside."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_\-]", "_"), "_+", "_"), "^_|_$", "")


def is_join_warning(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("cannot keep") | (low.contains("element") & low.contains("join"))


#: What family names hold, by kind.
CONCRETE_WORDS = ["CONCRETE", "RC ", "CJY", "CAST-IN-PLACE"]
COLUMN_WORDS = ["COLUMN", "RECTANGULAR", "ROUND", "CIRCULAR"]
NOT_CONCRETE_WORDS = ["UC-", "UB-", "UNIVERSAL", "I-BEAM", "WIDE FLANGE", "W-SHAPE"]
FRAMING_WORDS = ["STEEL", "I BEAM", "I-BEAM", "W-SHAPE", "WIDE FLANGE", "UB-", "UC-", "PURLIN", "L-ANGLE", "L ANGLE"]


def _holds(name: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))


def family_kinds(name: Column) -> dict[str, Column]:
    """Whether a family name reads as a universal column, a concrete column, or steel framing."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    universal = (upper.contains("UNIVERSAL") & upper.contains("COLUMN")) | upper.startswith("UC-") | upper.startswith("UC_")
    concrete = ~_holds(upper, NOT_CONCRETE_WORDS) & _holds(upper, CONCRETE_WORDS) & _holds(upper, COLUMN_WORDS)
    framing = _holds(upper, FRAMING_WORDS) | upper.startswith("UB ") | upper.startswith("UC ")
    return {"is_universal": universal, "is_concrete_column": concrete, "is_steel_framing": framing}


def is_round(shape: Column, type_mark: Column) -> Column:
    """By the stated shape, else by the type mark; equal sides alone are not round."""
    said, mark = F.upper(F.coalesce(shape, F.lit(""))), F.lower(F.coalesce(type_mark, F.lit("")))
    by_mark = mark.contains("round") | mark.contains("circ")
    return F.when(said.contains("CIRC") | said.contains("ROUND"), True).when(said.contains("RECT") | said.contains("SQ"), False).otherwise(by_mark)


def clamped_size(mm: Column, least: float = 200.0) -> Column:
    return F.greatest(mm, F.lit(least))


def rounded_size(mm: Column, step: float = 50.0) -> Column:
    return (F.bround(mm / step, 0) * step).cast("int")


def plain_type_name(x: Column, y: Column) -> Column:
    """Orientation-free: SQn for equal sides, else RECTminxmax."""
    low, high = (f(x, y).cast("int").cast("string") for f in (F.least, F.greatest))
    return F.when(F.abs(x - y) < 1.0, F.concat(F.lit("SQ"), x.cast("int").cast("string"))).otherwise(F.concat(F.lit("RECT"), low, F.lit("x"), high))


def parameter_value(kind: Column, raw: Column, feet_per_mm: float = 1 / 304.8) -> dict[str, Column]:
    """A written parameter by its storage: lengths in feet, raw numbers, integers, ids and text."""
    number = raw.try_cast("double")
    return {
        "as_double": F.when(kind == "mm", number * F.lit(feet_per_mm)).when(kind == "raw", number),
        "as_int": F.when(kind.isin("int", "id"), number.cast("long")),
        "as_text": F.when(kind == "string", raw),
    }
