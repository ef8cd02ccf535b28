"""H35. Sections of documents by rules that are data: what a line says and the section so far give its section; then lines move.

A line is a small map: for each section so far, and whether a heading was seen, the section after it. Maps are strings with a letter for each of these states, and
two that follow each other are one by translate(); so a document's maps are composed in log8(lines) passes of one window, each over eight times the lines of the one
before, and no document is gathered or folded. Refinement is line by line; moves are windows of the same documents, which are shuffled once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import SECTIONS, Move, SectionRules
from ..functions.text import HAN, norm_line
from .lines import by_doc, canon_line

SEEN = len(SECTIONS)
#: A letter for each section without a heading so far, and with one.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: 2 * SEEN]
#: The guard that any Han character meets.
HAN_GUARD = f"[{HAN}]"
MARKS = " ，,；;。"
#: What \\s stands for in patterns. Ends are cut by trim(), which looks at them alone, where a pattern with $ is tried at each character of a line.
BLANKS = " \t\n\x0b\f\r"
#: What clean_heading() takes from the start and from the end of a line: a line without either is its own clean form.
OPENING, CLOSING = f"■●◆▪▸►【[{BLANKS}（(0123456789一二三四五六七八九十：:|_·•-", f"]】{BLANKS}：:|_·•-"
LONGEST_HEADING = 40
CANON_MARKS = "：:；;，,。．.、|｜"
CELL_MARKS = r"|｜\t\n"
#: Maps that one pass of a window joins.
FOLD = 8


def letter(section: str, seen: bool) -> str:
    return LETTERS[SECTIONS.index(section) + SEEN * seen]


def quoted(names) -> str:
    return "|".join(rf"\Q{n}\E" for n in sorted(names, key=lambda n: (-len(n), n)))


def has_han(words) -> bool:
    """Whether each of the words holds a Han character, so that a line without one holds none of them."""
    return all(re.search("[\u4e00-\u9fa5]", w) for w in words)


def found_in(c: Column, words) -> Column:
    """Whether one of the words stands in a text. Those with a Han character are looked for where there is one."""
    han, others = [w for w in words if has_han([w])], [w for w in words if not has_han([w])]
    return reduce(Column.__or__, [*([c.rlike(HAN_GUARD) & c.rlike(quoted(han))] if han else []), *([c.rlike(quoted(others))] if others else [])], F.lit(False))


def odd(c: Column) -> Column:
    """Whether a line may hold marks of cells, blanks other than spaces, or Han characters. Each class is a range or a list of narrow characters, which Java tells fast; others take it many times as long."""
    return c.rlike(r"[|\t\n\x0b\f\r\x85\xa0]") | c.rlike(r"[\x{250}-\x{ffff}]")


def normal(c: Column, is_odd: Column | None = None) -> Column:
    """norm_line(), which rewrites every blank of a line, where that changes more than its ends. is_odd: odd() where it is known."""
    return F.when(F.contains(c, F.lit("  ")) | ((odd(c) if is_odd is None else is_odd) & c.rlike(r"(?U)[^\S ]")), norm_line(c)).otherwise(F.trim(c))


def without_blanks(c: Column) -> Column:
    return F.when(c.rlike(r"[\t-\r]"), F.regexp_replace(c, r"\s+", "")).otherwise(F.replace(c, F.lit(" "), F.lit("")))


def cells_of(line: Column) -> Column:
    return F.when(F.col("odd"), F.split(F.regexp_replace(line, r"\s\|\s|｜|\t+", "\n"), "\n")).otherwise(F.array(line))


def most_parts(line: Column, rules: SectionRules) -> Column:
    """At least the number of lines that expand_lines() makes of a line: marks between cells part it, and headings within, each of which holds a character that is cut out here."""
    cut = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    parts = 1 + cut(line, f"[{CELL_MARKS}]")
    if not rules.inline:
        return F.when(odd(line), parts).otherwise(1)
    names = cut(F.regexp_replace(line, r"(?U)\s", ""), quoted(re.sub(r"\s", "", n) for n in rules.inline))
    return F.when(odd(line), parts + names).otherwise(1) if has_han(rules.inline) else parts + names


def expand_lines(lines: DataFrame, rules: SectionRules) -> DataFrame:
    """Lines in parts: cells of a table, what follows a heading within a long line, and labels with their values from the next line; numbered anew, with odd()."""
    rows = lines.select("doc_id", "line_no", "line", odd(F.col("line")).alias("odd")).select("doc_id", "line_no", "odd", F.posexplode(cells_of(F.col("line"))).alias("i", "cell"))
    rows = rows.withColumn("cell", normal(F.col("cell"), F.col("odd"))).where("cell <> ''")
    parts = F.array("cell")
    if rules.inline:
        marked = F.regexp_replace(F.col("cell"), rf"(?<=[ 　,，;；。|/、)])({quoted(rules.inline)})(?=$|[ 　:：,，;；])", "\n$1")
        rows = rows.withColumn("apart", F.when((F.col("odd") if has_han(rules.inline) else F.lit(True)) & (F.length("cell") >= 24) & found_in(F.col("cell"), rules.inline), marked))
        parts = F.when(F.coalesce(F.col("apart") == F.col("cell"), F.lit(True)), parts).otherwise(F.transform(F.split("apart", "\n"), lambda p: F.trim(p, F.lit(MARKS))))
    rows = rows.select("doc_id", "line_no", "odd", "i", F.posexplode(parts).alias("j", "line")).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("line_no", "i", "j")
    if not rules.labels:
        return rows.select("doc_id", F.row_number().over(w).alias("line_no"), "line", "odd")
    # a label with a blank after each character, or with colons before or after it
    line, longest = F.col("line"), 2 * max(map(len, rules.labels))
    may = (F.length(line) <= longest) | F.substring(line, 1, 1).isin("：", ":") | F.substring(line, -1, 1).isin("：", ":")
    bare = F.lower(F.btrim(without_blanks(line), F.lit("：:")))
    rows = rows.select("doc_id", "line_no", "i", "j", "line", "odd", F.when(may, bare.isin(*rules.labels)).otherwise(False).alias("label"))
    rows = rows.withColumns({"n": F.row_number().over(w), "next": F.when(F.col("label"), F.lead("line").over(w))})
    # only what follows a label is looked at
    value = F.col("label") & (F.length("next") <= 80)
    rows = with_heading(rows, rules, "heading", value, "next")
    pairable = F.coalesce(value & F.col("heading").isNull() & F.col("next").rlike(r"[\x{4e00}-\x{9fa5}A-Za-z0-9]"), F.lit(False))
    # of labels that follow each other every second takes the next as its value; one order serves all windows, so that lines are sorted once
    rows = rows.withColumn("pairable", pairable).drop("label", "heading", "clean")
    rows = rows.withColumn("last", F.max(F.when(~F.col("pairable"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("takes", F.col("pairable") & ((F.col("n") - F.coalesce("last", F.lit(0))) % 2 == 1))
    taken = F.coalesce(F.lag("takes").over(w), F.lit(False))
    joined = F.when(F.col("takes"), F.concat(F.regexp_replace("line", "[：:]+$", ""), F.lit("："), F.col("next"))).otherwise(F.col("line"))
    return rows.select("doc_id", F.col("n").alias("line_no"), joined.alias("line"), (F.col("odd") | F.col("takes")).alias("odd"), taken.alias("taken")).where("NOT taken").drop("taken")


def clean_heading(line: Column) -> Column:
    """A line without the marks and numbers that stand before and after a heading."""
    clean = F.rtrim(F.ltrim(normal(line), F.lit(f"■●◆▪▸►【[{BLANKS}")), F.lit(f"]】{BLANKS}"))
    return F.btrim(F.regexp_replace(clean, r"^[（(]?[0-9一二三四五六七八九十]+[）).、．]\s*", ""), F.lit("：:|_ ·•-"))


def with_heading(lines: DataFrame, rules: SectionRules, name: str = "section_heading", where: Column | None = None, column: str = "line", norm: bool = False) -> DataFrame:
    """lines with the section that each is a heading of, and `clean`, the line as headings are compared. A column of its own, as each heading is held against it.
    Both are null where the condition does not hold, and for lines too long to be a heading from which nothing is taken. norm: whether the lines are as normal() leaves them."""
    rows = lines.withColumn("norm", F.col(column) if norm else F.when(F.lit(True) if where is None else where, normal(F.col(column))))
    may = (F.length("norm") <= LONGEST_HEADING) | F.substring("norm", 1, 1).isin(*OPENING) | F.substring("norm", -1, 1).isin(*CLOSING)
    rows = rows.withColumn("clean", F.when(may, F.lower(clean_heading(F.col("norm"))))).drop("norm")
    return rows.withColumn(name, heading(F.col("clean"), rules))


def heading(clean: Column, rules: SectionRules) -> Column:
    """The section, null for none: that of the longest heading that the line is, starts or ends with, or holds if it is short; a short value of a field is none."""
    n = F.length(clean)
    names = sorted(rules.headings, key=lambda h: (-len(h), list(rules.headings).index(h)))
    rows = ", ".join(f"named_struct('h', r'{h}', 's', '{rules.headings[h]}', 'n', {len(h)}, 'anywhere', {str(h in rules.anywhere).lower()})" for h in names)
    table = F.expr(f"array({rows})")

    def fits(a: Column) -> Column:
        marked = F.startswith(clean, F.concat(a["h"], F.lit("：")) ) | F.startswith(clean, F.concat(a["h"], F.lit(":")))
        value = F.trim(F.substring(clean, a["n"] + 2, n))
        field = (value != "") & (F.length(value) <= 12) & ~value.rlike(rules.no_field or "$^")
        holds = F.contains(clean, a["h"])
        near = F.endswith(clean, a["h"]) & (n <= a["n"] + 4)
        within = (a["n"] > 2) & holds & (n <= F.greatest(a["n"] + 6, F.lit(18)))
        return (clean == a["h"]) | F.when(marked, ~field).otherwise(near | within | (a["anywhere"] & holds))

    def resolved(a: Column) -> Column:
        out = a["s"]
        for section, pattern, other in reversed(rules.resolve):
            out = F.when((a["s"] == section) & clean.rlike(pattern), other).otherwise(out)
        return out

    found = F.filter(F.transform(F.filter(table, fits), resolved), lambda s: s != "")
    return F.when((n > 0) & (n <= LONGEST_HEADING) & found_in(clean, rules.headings), F.try_element_at(found, F.lit(1)))


def wording(text: str) -> str:
    """SQL of a clause: all its names hold, and none of those after !. Rules are put together as text, as they are many small expressions."""
    return " AND ".join(f"NOT `{t[1:]}`" if t.startswith("!") else f"`{t}`" for t in text.split()) or "true"


def cases(pairs, otherwise: str) -> str:
    """The first value whose condition is true."""
    pairs = list(pairs)
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in pairs)} ELSE {otherwise} END" if pairs else otherwise


def parted(pattern: str) -> tuple[str, str]:
    """Those alternatives of a pattern that are words with a Han character, and all others; no pattern where there are none."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    parts, depth = [""], 0
    for c in pattern.removeprefix(flag):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    words = [p for p in parts if re.fullmatch(r"\w+", p) and re.search("[\u4e00-\u9fa5]", p)]
    join = lambda found: flag + "|".join(found) if found else ""
    return join(words), join([p for p in parts if p not in words])


def hint_pattern(part: str) -> bool:
    return len(part) > 1 and part[0] == part[-1] == "/"


def prepared(lines: DataFrame, rules: SectionRules) -> DataFrame:
    """lines with whether each meets the guard, and whether it holds a part that hints at a signal without that."""
    pattern, guarded = rules.guard
    guard = F.expr(f"line RLIKE r'{pattern}'") if guarded else F.lit(True)
    lines = lines if "odd" in lines.columns else lines.withColumn("odd", odd(F.col("line")))
    lines = lines.withColumn("guard", F.col("odd") & guard if pattern == HAN_GUARD else guard).withColumn("low", F.when(~F.col("guard"), F.lower("line")))
    return lines.withColumn("hinted", ~F.col("guard") & F.expr(" OR ".join(map(hint, dict.fromkeys(p for found in rules.hints.values() for p in found))) or "false"))


def hint(part: str) -> str:
    """SQL of whether a line holds a part of SectionRules.hints."""
    return f"line RLIKE r'(?i){part[1:-1]}'" if len(part) > 1 and part[0] == part[-1] == "/" else f"contains(low, '{part}')"


def own_signals(rules: SectionRules, tight: str = "tight") -> dict[str, str]:
    """SQL of each signal and size of prepared() lines; tight: of the line without blanks."""
    pattern, guarded = rules.guard

    def meets(name: str, whole: str) -> str:
        column = tight if name in rules.compact else "line"
        if name in guarded or not guarded:
            return f"guard AND {column} RLIKE r'{whole}'"
        # words with a Han character are looked for where there is one
        words, rest = parted(whole) if pattern == HAN_GUARD else ("", whole)
        if name in rules.hints:
            return f"(guard AND {column} RLIKE r'{whole}') OR (hinted AND ({' OR '.join(map(hint, rules.hints[name])) or 'false'}) AND {column} RLIKE r'{rest or whole}')"
        return " OR ".join([*([f"(guard AND {column} RLIKE r'{words}')"] if words else []), *([f"{column} RLIKE r'{rest}'"] if rest else [])])

    sizes = {n: f"length({tight if compact else 'line'}) BETWEEN {least or 0} AND {2**31 - 1 if most is None else most}" for n, (compact, least, most) in rules.sizes.items()}
    return {n: meets(n, p) for n, p in rules.signals.items()} | sizes | {"heading": "section_heading IS NOT NULL"}


def levels(rules: SectionRules) -> list[dict[str, str]]:
    """SQL of the predicates, level by level, as each may name others."""
    known, left, out = {*rules.signals, *rules.sizes, "heading"}, dict(rules.predicates), []
    while left:
        ready = {n: cs for n, cs in left.items() if all(t.lstrip("!") in known for c in cs for t in c.split())}
        if not ready:
            raise ValueError(f"unknown names in {sorted(left)}")
        out.append({n: " OR ".join(f"({wording(c)})" for c in cs) for n, cs in ready.items()})
        known |= set(ready)
        left = {n: cs for n, cs in left.items() if n not in ready}
    return out


def signals(lines: DataFrame, rules: SectionRules) -> DataFrame:
    """A column for each signal, size and predicate."""
    rows = prepared(lines, rules).withColumn("tight", without_blanks(F.col("line")))
    for group in (own_signals(rules), *levels(rules)):
        rows = rows.withColumns({n: F.expr(sql) for n, sql in group.items()})
    return rows


def named(sql: str, paths: dict[str, str]) -> str:
    """SQL in which names in backticks stand for other SQL."""
    return re.sub("`([^`]+)`", lambda m: paths[m[1]], sql)


def plain_signals(rules: SectionRules) -> dict[str, str]:
    return {n: f"({sql})" for n, sql in own_signals(rules, r"regexp_replace(line, r'\s+', '')").items()}


def without(rules: SectionRules) -> Callable[[str], str]:
    """What is left of a clause, as SQL, for lines that are no headings and meet neither the guard nor a hint: true, false, or what it still asks."""
    never = {"heading", *rules.guard[1], *(rules.hints if rules.guard[1] else ())}

    @cache
    def one(name: str) -> str:
        return "false" if name in never else some(rules.predicates[name]) if name in rules.predicates else f"`{name}`"

    def some(clauses) -> str:
        found = [every(c) for c in clauses]
        return "true" if "true" in found else " OR ".join(dict.fromkeys(f"({f})" for f in found if f != "false")) or "false"

    def every(text: str) -> str:
        found = [one(t) if not t.startswith("!") else {"true": "false", "false": "true"}.get(one(t[1:]), f"NOT ({one(t[1:])})") for t in text.split()]
        return "false" if "false" in found else " AND ".join(f"({f})" for f in found if f != "true") or "true"

    return every


def said(lines: DataFrame, rules: SectionRules, facts: Facts) -> DataFrame:
    """What each line says, in a few values: its map, its refinement, what moves ask, the heading as a bit, whether it is but a heading, and what near_heading() asks.

    Most lines of other scripts say nothing: they meet neither the guard nor a hint, and no clause holds without these. Their values are known beforehand; signals of all others are in structs, null for these, so
    that rows stay short.
    """
    lines, own, deeper = prepared(lines, rules), own_signals(rules), levels(rules)
    around, left = {m.around: m for m in rules.moves if m.around}, without(rules)
    told = [left(t) for t in (*(text for _, text, _ in rules.opens), *(text for _, text, target in rules.refine if target != "="), *(t for m in around.values() for t in (m.clause, m.also)))]
    told += [v for v in map(left, facts.texts) if v != "true"]
    told = ["guard", "hinted", "section_heading IS NOT NULL", *dict.fromkeys(v for v in told if v != "false")]
    # parts of other columns where the line says nothing
    plain = plain_signals(rules)
    lines = lines.withColumn("told", F.expr(named(" OR ".join(f"({t})" for t in told), plain)))
    # rows of lines that say nothing stay short
    lines, paths = lines.withColumn("low", F.when(F.col("told"), F.col("low"))).withColumn("tight", F.when(F.col("told"), without_blanks(F.col("line")))), {}
    for k, group in enumerate((own, *deeper)):
        fields = ", ".join(f"'{n}', {named(sql, paths)}" for n, sql in group.items())
        lines = lines.withColumn(f"said_{k}", F.expr(f"IF(told, named_struct({fields}), NULL)"))
        paths |= {n: f"`said_{k}`.`{n}`" for n in group}
    either = lambda sql, otherwise: F.expr(f"IF(told, {named(sql, paths)}, {named(otherwise, plain)})")
    by_text = F.create_map(*(F.lit(x) for pair in rules.headings.items() for x in pair))
    pure = F.coalesce(F.try_element_at(by_text, F.col("clean")) == F.col("section_heading"), F.lit(False)) | (F.col("clean") == "")
    for name, text in rules.empty.items():
        pure = pure | ((F.col("section_heading") == name) & F.expr(named(wording(text), paths)))
    out = {"map": either(step(rules), f"'{LETTERS}'"), "refined": either(refinement(rules), f"'{LETTERS[:SEEN]}'")}
    out["facts"] = either(facts.sql(wording), facts.sql(left))
    out["head"] = F.expr(cases(((f"section_heading = '{s}'", str(1 << i)) for i, s in enumerate(SECTIONS)), "0"))
    out["gone"] = F.col("section_heading").isNotNull() & pure
    for section, move in around.items():
        out[f"at_{section}"] = either(near_bits(move, wording), near_bits(move, lambda text: "false" if text == move.stops else left(text)))
    return lines.select("doc_id", "line_no", "line", "odd", "told", *(c.alias(n) for n, c in out.items()))


def allowed(rules: SectionRules, source: str, target: str, seen: bool) -> str:
    """SQL of whether a document goes over from a section to the one that a line opens: the first switch that applies says."""
    fit = [(wording(text), str(verdict).lower()) for froms, tos, when, text, verdict in rules.switches if (froms is None or source in froms) and (tos is None or target in tos) and when in (None, seen)]
    return cases(fit, "false")


def step(rules: SectionRules) -> str:
    """SQL of a line's map: the letter of each state's next one."""
    out = []
    for seen in (False, True):
        for source in SECTIONS:
            stay = f"'{letter(source, seen)}'"
            moves = [(wording(text), stay if target in ("=", source) else f"IF({allowed(rules, source, target, seen)}, '{letter(target, seen)}', {stay})") for froms, text, target in rules.opens if froms is None or source in froms]
            out.append(cases(moves, stay))
    heads = cases(((f"section_heading = '{s}'", f"'{letter(s, True) * len(LETTERS)}'") for s in SECTIONS), "''")
    opens = " OR ".join(f"({c})" for c in dict.fromkeys(wording(text) for _, text, _ in rules.opens)) or "false"
    return f"CASE WHEN `heading` THEN {heads} WHEN {opens} THEN concat({', '.join(out)}) ELSE '{LETTERS}' END"


def composed(lines: DataFrame, longest: int, column: str = "map") -> DataFrame:
    """Each line's map after those of all lines before it in its document; longest: lines of a document at most. A pass joins the maps of FOLD lines."""
    w, names = by_doc(), [f"before_{i}" for i in range(1, FOLD)]

    def after(map_: Column, before: Column) -> Column:
        # what changes nothing, or leaves a single section, is told without translate()
        one = F.substring(map_, 1, 1) == F.substring(map_, -1, 1)
        return F.when(before.isNull() | (one & (map_ == F.repeat(F.substring(map_, 1, 1), F.lit(len(LETTERS))))), map_).when(map_ == LETTERS, before).otherwise(F.call_function("translate", before, F.lit(LETTERS), map_))

    reach = 1
    while reach < longest:
        lines = lines.withColumns({name: F.lag(column, reach * i).over(w) for i, name in enumerate(names, 1)})
        for name in names:
            lines = lines.withColumn(column, after(F.col(column), F.col(name))).drop(name)
        reach *= FOLD
    return lines


def section_of(state: Column) -> Column:
    number = (F.ascii(state) - ord("A")) % SEEN
    return F.element_at(F.array(*map(F.lit, SECTIONS)), (number + 1).cast("int"))


def without_marks(bare: Column, is_odd: Column) -> Column:
    """The canonical form of a line without blanks."""
    return F.lower(F.when(is_odd, F.regexp_replace(bare, rf"(?U)[{CANON_MARKS}\s]+", "")).otherwise(F.regexp_replace(bare, r"[:;,.|\t\n\x0b\f\r\x85\xa0]+", "")))


def key_of(canon: Column) -> Column:
    """The canonical form, or its SHA-256, which has 64 digits, if it is long."""
    return F.when(F.length(canon) <= 40, canon).otherwise(F.sha2(canon, 256))


def has_text(line: Column) -> Column:
    """Whether the canonical form is not empty."""
    return line.rlike(rf"(?U)[^{CANON_MARKS}\s]")


def first_seen(rows: DataFrame) -> DataFrame:
    """The first of a document's lines of a section that are equal in their canonical form."""
    w = Window.partitionBy("doc_id", "place", "key").orderBy("line_no")
    return rows.withColumn("seen", F.row_number().over(w)).where("seen = 1").drop("seen")


def refinement(rules: SectionRules) -> str:
    """SQL of a letter for each section: where a line belongs that stands in it."""
    own = lambda source, target: f"'{letter(source if target == '=' else target, False)}'"
    whole = "concat(" + ", ".join(cases(((wording(text), own(source, target)) for froms, text, target in rules.refine if froms is None or source in froms), own(source, "=")) for source in SECTIONS) + ")"
    leaves = " OR ".join(f"({c})" for c in dict.fromkeys(wording(text) for _, text, target in rules.refine if target != "=")) or "false"
    return f"IF({leaves}, {whole}, '{LETTERS[:SEEN]}')"


class Facts:
    """What the moves ask of a line, as bits of one number, so that no signal goes on beyond them."""

    def __init__(self, rules: SectionRules) -> None:
        asked = [t for m in rules.moves for t in (m.clause, *((m.held[1],) if m.held else ()))] + [f[1] for f in rules.fragments] + [*rules.makes_room, *rules.empty.values()]
        self.texts = list(dict.fromkeys(asked))
        if len(self.texts) > 62:
            raise ValueError("62 different clauses in moves at most")

    def sql(self, say: Callable[[str], str]) -> str:
        return " | ".join(["0L", *(f"IF({say(t)}, {1 << i}L, 0L)" for i, t in enumerate(self.texts))])

    def hold(self, text: str) -> Column:
        return F.col("facts").bitwiseAND(F.lit(1 << self.texts.index(text)).cast("bigint")) != 0


#: What near_heading() asks of a line, a bit each.
NEAR = {name: 1 << i for i, name in enumerate(("takes", "after", "own", "other", "stops"))}


def near_bits(move: Move, say: Callable[[str], str]) -> str:
    after = f"({say(move.clause)} OR {say(move.also)})"
    own = f"coalesce(section_heading = '{move.around}', false)"
    flags = {"takes": say(move.clause), "after": after, "own": own, "other": f"section_heading IS NOT NULL AND NOT {own}", "stops": f"NOT {after} AND ({say(move.stops)})"}
    return " | ".join(f"IF({sql}, {NEAR[name]}, 0)" for name, sql in flags.items())


def with_stops(rows: DataFrame, move: Move, rules: SectionRules, reach: int = 7) -> DataFrame:
    """rows whose bits tell of plain lines, too, whether they stop: of those alone that come soon after a heading."""
    sql, bits = without(rules)(move.stops), f"at_{move.around}"
    if sql == "false":
        return rows
    soon = reduce(Column.__or__, (F.coalesce(F.lag(bits, k).over(by_doc()).bitwiseAND(F.lit(NEAR["own"])) != 0, F.lit(False)) for k in range(1, reach)))
    rows = rows.withColumn("soon", ~F.col("told") & soon)
    after = F.col(bits).bitwiseAND(F.lit(NEAR["after"])) != 0
    return rows.withColumn(bits, F.when(F.col("soon") & ~after & F.expr(named(sql, plain_signals(rules))), F.col(bits).bitwiseOR(F.lit(NEAR["stops"]))).otherwise(F.col(bits))).drop("soon")


def near_heading(bits: str, reach: int = 7) -> Column:
    """Whether a line is up to `reach` from a heading of move.around: before it in a run for which the clause holds, after which nothing else of that kind comes; or after it, itself
    one for which the clause or `also` holds, without any line between that stops. Other headings end both. bits: the column of near_bits()."""
    has = lambda x, name: x.bitwiseAND(F.lit(NEAR[name])) != 0
    w, line = by_doc(), F.col(bits)

    def reaches(lines: list[Column], ends) -> Column:
        start = F.struct(F.lit(False).alias("found"), F.lit(False).alias("over"), F.lit(False).alias("gap"))

        def add(state: Column, x: Column) -> Column:
            found = state["found"] | (~state["over"] & has(x, "own"))
            return F.struct(found.alias("found"), (state["over"] | has(x, "other") | ends(state, x)).alias("over"), (state["gap"] | ~has(x, "takes")).alias("gap"))

        return F.aggregate(F.array_compact(F.array(*lines)), start, add)["found"]

    before = has(line, "takes") & reaches([F.lead(bits, k).over(w) for k in range(1, reach + 1)], lambda state, x: has(x, "takes") & state["gap"])
    behind = has(line, "after") & reaches([F.lag(bits, k).over(w) for k in range(1, reach + 1)], lambda state, x: has(x, "stops"))
    return ~has(line, "other") & (before | behind)


def stands(section: str) -> Column:
    """Whether a line, or a copy of it, stands in a section. `place` has a letter for each of these."""
    return F.contains("place", F.lit(letter(section, False)))


def moved(rows: DataFrame, move: Move, facts: Facts) -> DataFrame:
    """rows after one move. A column `held` of the move before serves this one too if it asks for the same."""
    doc, target = Window.partitionBy("doc_id"), letter(move.target, False)
    shows = lambda section: F.col("headings").bitwiseAND(F.lit(1 << SECTIONS.index(section))) != 0
    fits = F.col(f"near_{move.around}") if move.around else facts.hold(move.clause)
    if move.held:
        fits = fits & (F.col("held") == move.held[2])
    if move.heading:
        fits = fits & shows(move.heading)
    if move.no_heading:
        fits = fits & ~shows(move.no_heading)
    sources = [s for s in move.sources if s != move.target]
    fits = fits & reduce(Column.__or__, map(stands, sources), F.lit(False))
    which = lambda values: F.coalesce(*(F.when(stands(s), v) for s, v in zip(sources, values))) if sources else F.lit(None)
    # both windows in one pass: a document whose target is not empty has no first line either
    whole, order = {}, F.struct(which(map(F.lit, range(len(sources)))).alias("o"), "line_no")
    if move.first:
        rows, fits = rows.withColumn("fits", fits), F.col("fits")
        whole["first"] = F.min(F.when(fits, order)).over(doc)
    if move.if_empty:
        whole["some"] = F.max(stands(move.target)).over(doc)
    rows = rows.withColumns(whole) if whole else rows
    if move.if_empty:
        fits = fits & ~F.col("some")
    if move.first:
        fits = fits & (order == F.col("first"))
    letters = [letter(s, False) for s in sources]
    if move.copy:
        place = F.concat("place", F.lit(target))
    elif move.first:
        place = which(F.translate("place", x, target) for x in letters)
    else:
        place = F.translate("place", "".join(letters), target * len(letters))
    return rows.withColumn("place", F.when(fits, place).otherwise(F.col("place"))).drop("fits", *whole)


def apart(rows: DataFrame) -> DataFrame:
    """A row for each section that a line stands in."""
    return rows.withColumn("place", F.explode(F.when(F.length("place") == 1, F.array("place")).otherwise(F.regexp_extract_all("place", F.lit("."), F.lit(0)))))


def with_fragments(rows: DataFrame, rules: SectionRules, facts: Facts) -> DataFrame:
    """rows, and those parts of them that are lines of another section; where there are some, lines of that section that make room go."""
    parts = [F.when(stands(source) & facts.hold(text), F.struct(F.nullif(F.trim(F.regexp_extract("line", pattern, 1)), F.lit("")).alias("line"), F.lit(letter(target, False)).alias("place"))) for source, text, pattern, target in rules.fragments]
    some = reduce(Column.__or__, (stands(source) & facts.hold(text) for source, text, _, _ in rules.fragments))
    rows = rows.withColumn("parts", F.when(some, F.filter(F.array(*parts), lambda p: p["line"].isNotNull())))
    has = F.coalesce(F.size("parts") > 0, F.lit(False))
    found = F.max(has).over(Window.partitionBy("doc_id"))
    targets = {letter(f[3], False) for f in rules.fragments}
    gone = F.col("place").isin(*targets) & reduce(Column.__or__, map(facts.hold, rules.makes_room), F.lit(False))
    rows = rows.withColumn("found", found).where(~(F.col("found") & gone))
    rest = [c for c in rows.columns if c not in ("line", "place", "key", "parts", "found")]
    own = F.array(F.struct("line", "place", "key"))
    made = F.transform(F.filter("parts", lambda p: has_text(p["line"])), lambda p: F.struct(p["line"], p["place"], key_of(without_marks(F.replace(p["line"], F.lit(" "), F.lit("")), F.lit(True))).alias("key")))
    return rows.select(*rest, F.explode(F.when(has, F.concat(own, made)).otherwise(own)).alias("p")).select(*rest, "p.line", "p.place", "p.key")


def place_lines(lines: DataFrame, rules: SectionRules, expanded: bool = True) -> DataFrame:
    """H35. doc_id, line_no, line, section of all lines of documents but their headings and repeated ones; lines may be copied to a section that would be empty.

    lines: doc_id, line_no, line. line_no: as expand_lines() numbers them, if `expanded`. Documents begin in basic_info. Null and blank lines are left out; an empty table gives none.
    """
    rows = lines.select("doc_id", "line_no", "line").where(F.trim("line") != "")
    rows = expand_lines(rows, rules) if expanded else rows
    facts, around = Facts(rules), {m.around: m for m in rules.moves if m.around}
    known = said(with_heading(rows.repartition("doc_id"), rules, norm=expanded), rules, facts)
    for move in around.values():
        known = with_stops(known, move, rules)
    every = by_doc().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = known.select("doc_id", "line_no", "line", "odd", "map", "refined", "facts", "gone", F.bit_or("head").over(every).alias("headings"), *(near_heading(f"at_{section}").alias(f"near_{section}") for section in around))
    longest = lines.groupBy("doc_id").agg(F.sum(most_parts(F.col("line"), rules) if expanded else F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    number = (F.ascii(F.substring("map", 1, 1)) - ord("A")) % SEEN + 1
    placed = composed(kept, longest).where(~F.col("gone") & has_text(F.col("line"))).withColumn("number", number.cast("int")).drop("map", "gone")
    placed = placed.withColumn("place", F.substring(F.lit(LETTERS[:SEEN]), F.col("number"), F.lit(1))).withColumn("bare", F.replace("line", F.lit(" "), F.lit("")))
    placed = placed.withColumn("canon", without_marks(F.col("bare"), F.col("odd"))).withColumn("key", key_of(F.col("canon"))).drop("bare", "canon", "odd")
    out = first_seen(placed).withColumn("place", F.substring(F.col("refined"), F.col("number"), F.lit(1))).drop("refined", "number")
    held = None
    for k, move in enumerate(rules.moves):
        if k == 2 and rules.fragments:
            out = with_fragments(apart(out) if any(m.copy for m in rules.moves[:k]) else out, rules, facts)
        if move.held and move.held[:2] != held:
            held = move.held[:2]
            out = out.withColumn("held", F.max(stands(held[0]) & facts.hold(held[1])).over(Window.partitionBy("doc_id")))
        held = move.held[:2] if move.held else None
        out = moved(out, move, facts)
    out = first_seen(apart(out) if any(m.copy for m in rules.moves) else out)
    return out.select("doc_id", "line_no", "line", section_of(F.col("place")).alias("section"))
