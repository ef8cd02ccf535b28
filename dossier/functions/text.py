"""Text columns: normal forms, tokens, contacts, redaction, dates, labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MAJOR_HINT, NOT_A_NAME, NOT_NAMES

#: Fixed patterns, in the order in which they are redacted.
PII = (
    ("id_card", r"\b[0-9]{17}[0-9Xx]\b", "[ID]"),
    ("phone", r"(\+[0-9]{1,3}[ -]?)?(\([0-9]{2,4}\)[ -]?|\b[0-9]{3}[ -])[0-9]{3,4}[ -]?[0-9]{4}\b", "[PHONE]"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    ("url", r"https?://[^\s<>]+", "[URL]"),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[IP]"),
    ("long_number", r"\b[0-9]{12,19}\b", "[NUMBER]"),
)
HAN = r"\x{4e00}-\x{9fa5}"
MOBILE = r"(?:\+?86[-\s]?)?1[3-9][0-9][-\s]?[0-9]{4}[-\s]?[0-9]{4}"
#: What costs less to look for, and without which a text holds none of a kind: parts of which it has one, and a pattern that begins with a character.
MAYBE = {
    "mobile": ((), r"1[3-9][0-9][-\s]?[0-9]{4}"), "phone": ((), r"[0-9)](?:[ -]|(?<=[)]))[0-9]{3,4}[ -]?[0-9]{4}"), "email": (("@",), ""), "url": (("://",), ""),
    "id_card": ((), "[0-9][0-9]{16}"), "ip": ((), "[0-9][.][0-9]{1,3}[.][0-9]"), "long_number": ((), "[0-9][0-9]{11}"),
}
#: Fixed patterns of what is masked besides PII: kind, pattern, what stands for it (labels stay), and parts of which a text must hold one.
MARKED = (
    ("account", r"(?i)((?:github[.]com|gitee[.]com)/[A-Za-z0-9_.-]+)", "[ACCOUNT]", ("/",)),
    ("qq", r"((?:QQ|qq)\s*[:：]?\s*)([1-9][0-9]{4,11})", "$1[QQ]", ("QQ", "qq")),
    ("wechat", r"((?:微信|WeChat|wechat|WX|wx)\s*[:：]?\s*)([A-Za-z][\p{L}\p{N}_-]{2,30})", "$1[WECHAT]", ("微信", "WeChat", "wechat", "WX", "wx")),
    ("address", rf"((?:现居|现居地|居住地|所在地|通讯地址|家庭住址|地址)\s*[:：]?\s*)([{HAN}A-Za-z0-9-]{{4,40}})", "$1[ADDRESS]", ("现居", "居住地", "所在地", "址")),
    ("school", rf"([{HAN}A-Za-z]{{2,20}}?(?:大学|学院|职业技术学院|职业技术大学|研究院|高等专科学校)[{HAN}]{{0,8}})", "[SCHOOL]", ("大学", "学院", "研究院", "高等专科学校")),
    ("company", rf"([{HAN}A-Za-z0-9（）()]{{2,24}}(?:有限公司|股份有限公司|集团有限公司|科技公司|网络公司|传媒公司|文化公司))", "[COMPANY]", ("公司",)),
)
#: All kinds, in the order in which they are masked; numbers and addresses of machines come after what labels tell.
KINDS = ("id_card", "mobile", "phone", "email", "url", *(k for k, *_ in MARKED), "ip", "long_number", "name")
NAME_LABEL = rf"(?i)(?:姓名|名字|Name)\s*[:：]\s*([·{HAN}]{{2,4}})"
NAME = rf"^[{HAN}]{{2,4}}(?:·[{HAN}]{{1,3}})?$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
PHONE = r"(?:\+[0-9]{1,3}[ -]?)?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}"


def norm_line(c: Column) -> Column:
    """H1. Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def canon_line(c: Column) -> Column:
    """H1. Lower case without white space and punctuation at the ends."""
    return F.regexp_replace(F.lower(norm_line(c)), r"^[ .,;:!?-]+|[ .,;:!?-]+$", "")


def job_tokens(c: Column) -> Column:
    """H2. Distinct words of two characters at least, ASCII or Han, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9+#.-]+|[\x{4e00}-\x{9fa5}]{2,}"), F.lit(0)))


def vector_tokens(c: Column, aliases: Mapping[str, str], most: int | None = None) -> Column:
    """H2. ASCII words and pairs of Han characters, each followed by its root where it has one; all of them, or the first `most`."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9+#.]*"), F.lit(0))
    han = F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fa5}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(han, lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))))
    tokens = F.concat(words, pairs)
    if aliases:
        roots = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        tokens = F.flatten(F.transform(tokens, lambda t: F.array_compact(F.array(t, F.nullif(F.try_element_at(roots, t), t)))))
    return tokens if most is None else F.slice(tokens, 1, most)


def absent_roots(c: Column, aliases: Mapping[str, str]) -> Column:
    """H20. Roots of which a text holds another name, but not the root itself."""
    held = lambda low: F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(a)) & ~F.contains(low, F.lit(r)), F.lit(r)) for a, r in aliases.items()))))
    return let(F.lower(c), held) if aliases else F.array().cast("array<string>")


def contains_kw(text: Column, kw: str) -> Column:
    """H3. Letters and + # . match as whole words (a full stop after them does not count), anything else as a part. text is in lower case."""
    kw = kw.strip().lower()
    if len(kw) >= 2 and all(c in "abcdefghijklmnopqrstuvwxyz+#." for c in kw):
        quoted = "".join(f"[{c}]" if c in "+#." else c for c in kw)
        return text.rlike(rf"(?<![a-z0-9+#.]){quoted}\.*(?![a-z0-9+#.])")
    return F.contains(text, F.lit(kw)) if kw else F.lit(False)


def variants(kw: str, aliases: Mapping[str, str]) -> set[str]:
    """H3. A word, its root, and the other names of that root."""
    kw = kw.strip().lower()
    root = aliases.get(kw, kw)
    return {kw, root, *(a for a, r in aliases.items() if r == root)} - {""}


def contacts(c: Column) -> Column:
    """H4. email, phone (without the country's prefix), messenger ids wechat and qq, salary and location, empty where there is none (null: null)."""
    phone = F.regexp_replace(F.regexp_extract(c, PHONE, 0), r"^\+[0-9]{1,3}[ -]?", "")
    mobile = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, rf"(?<![0-9]){MOBILE}(?![0-9])", 0), "[^0-9]", ""), "^86", "")
    first = lambda *found: F.when(c.isNotNull(), F.coalesce(F.try_element_at(F.filter(F.array(*found), lambda x: x != ""), F.lit(1)), F.lit("")))
    return F.struct(
        F.when(F.contains(c, F.lit("@")), F.regexp_extract(c, EMAIL, 0)).when(c.isNotNull(), "").alias("email"), first(mobile, phone).alias("phone"),
        F.when(_holds(F.lower(c), ("微信", "wechat")), F.regexp_extract(c, r"(?i)(?:微信|Wechat)\s*[:：]?\s*([A-Za-z0-9_-]{3,30})", 1)).when(c.isNotNull(), "").alias("wechat"), F.regexp_extract(c, r"(?:QQ|qq)\s*[:：]?\s*([1-9][0-9]{4,11})", 1).alias("qq"),
        first(F.regexp_extract(c, r"(?:期望薪资|薪资|薪酬)\s*[:：]?\s*([0-9kK千万元+~—至到/-]+(?:/月|每月|月)?|面议)", 1), F.regexp_extract(c, r"(?i)(?:salary|gehalt|salaire)\s*[:=]\s*([0-9kK -]+)", 1)).alias("salary"),
        first(F.regexp_extract(c, rf"(?:现居|现居地|居住地|所在地|地址)\s*[:：]?\s*([{HAN}A-Za-z]{{2,20}})", 1), F.regexp_extract(c, r"(?i)(?:location|address|ort|ville)\s*[:=]\s*([^\n,;]{2,40})", 1)).alias("location"),
    )


def is_name(c: Column) -> Column:
    """H4, H5. Whether a string looks like a person's name: two to four Han characters that are no other known word, subject or body."""
    return c.rlike(NAME) & ~c.isin(*NOT_NAMES) & ~(c.rlike(MAJOR_HINT) & (F.length(c) >= 3)) & ~c.rlike(NOT_A_NAME)


def name_hint(c: Column) -> Column:
    """H4. The name that a text gives: at a label, else a line or a cell of one among the first 12 lines; empty without one (null: null)."""
    cells = F.flatten(F.transform(F.slice(F.split(c, "\n"), 1, 12), lambda x: F.split(x, "[|]")))
    tidy = F.transform(F.filter(cells, lambda x: x.rlike(rf"(?U)^\s*[{HAN}]")), norm_line)
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(F.filter(F.array_prepend(tidy, F.regexp_extract(c, NAME_LABEL, 1)), is_name), F.lit(1)), F.lit("")))


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c computed once."""
    return F.transform(F.array(c), then)[0]


def _holds(text: Column, parts: Sequence[str]) -> Column:
    """Whether a text holds one of the parts; true where none are given."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts)) if parts else F.lit(True)


def _maybe(text: Column, parts: Sequence[str], like: str = "") -> Column:
    """Whether a text holds one of the parts and meets the pattern, of those that are given."""
    return _holds(text, parts) & text.rlike(like) if like else _holds(text, parts)


def _masked(state: Column, pattern: str | Column, mark: str, parts: Sequence[str] = (), like: str = "") -> Column:
    """state is (text, counts); one more count, and the text with marks where it is not 0."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    counted = F.struct(state["text"].alias("text"), state["counts"].alias("counts"), F.when(_maybe(state["text"], parts, like), F.regexp_count(state["text"], pattern)).otherwise(0).alias("n"))
    return let(counted, lambda s: F.struct(F.when(s["n"] > 0, F.regexp_replace(s["text"], pattern, F.lit(mark))).otherwise(s["text"]).alias("text"), F.concat(s["counts"], F.array(s["n"])).alias("counts")))


def _masked_bodies(state: Column, pattern: str, mark: str, parts: Sequence[str]) -> Column:
    """As _masked, for patterns that end at white space: only lines that hold a part are looked at. Matches with the word for students stay; two code points
    that no text may hold stand around a match meanwhile."""
    around = lambda x: F.regexp_replace(F.regexp_replace(x, pattern, "\ufdd0$1\ufdd1"), "\ufdd0([^\ufdd1]*大学生[^\ufdd1]*)\ufdd1", "$1") if mark == "[SCHOOL]" else F.regexp_replace(x, pattern, "\ufdd0$1\ufdd1")
    line = lambda x: F.when(_holds(x, parts), F.regexp_replace(around(x), "\ufdd0[^\ufdd0\ufdd1]+\ufdd1", mark)).otherwise(x)
    text = F.when(_holds(state["text"], parts), F.array_join(F.transform(F.split(state["text"], "\n"), line), "\n")).otherwise(state["text"])
    count = lambda t: F.when(_holds(t, (mark,)), F.regexp_count(t, F.lit(mark.replace("[", r"\[").replace("]", r"\]")))).otherwise(0)
    held = F.struct(text.alias("text"), state["text"].alias("old"), state["counts"].alias("counts"))
    return let(held, lambda s: F.struct(s["text"].alias("text"), F.concat(s["counts"], F.array(count(s["text"]) - count(s["old"]))).alias("counts")))


def redact(c: Column) -> Column:
    """H5. text with personal data masked, in the order of KINDS, and how many of each kind; runs of blanks become one. Null: empty.

    Names are those at a label and the one that opens the first line; a name is masked wherever it stands by itself.
    """
    state = F.struct(F.coalesce(c, F.lit("")).alias("text"), F.array().cast("array<int>").alias("counts"))
    known = {k: (p, m, *MAYBE.get(k, ((), ""))) for k, p, m in (*PII, ("mobile", rf"(?<![0-9]){MOBILE}(?![0-9])", "[PHONE]"))} | {k: tuple(x) for k, *x in MARKED}
    for kind in KINDS[:-1]:
        masked = _masked_bodies if kind in ("school", "company") else _masked
        state = let(state, lambda s: masked(s, *known[kind]))  # noqa: B023 (called at once)
    head = lambda t: F.trim(F.regexp_extract(t, r"^\s*([^\s|/／]+)", 1))
    names = lambda t: F.array_distinct(F.filter(F.array_append(F.regexp_extract_all(t, F.lit(NAME_LABEL), F.lit(1)), head(F.split(t, "\n")[0])), is_name))
    alone = lambda n: F.concat(F.lit(f"(?<![{HAN}·])(?:"), F.when(F.size(n) > 0, F.array_join(n, "|")).otherwise("(?!)"), F.lit(f")(?![{HAN}·])"))
    named = lambda t: t.rlike(rf"^\s*[{HAN}]") | _holds(F.lower(t), ("姓名", "名字", "name"))
    han = lambda s: F.when(named(s["text"]), names(s["text"])).otherwise(F.array().cast("array<string>"))
    state = let(state, lambda s: F.struct(s["text"].alias("text"), s["counts"].alias("counts"), han(s).alias("names")))
    none = lambda s: F.struct(s["text"].alias("text"), F.array_append(s["counts"], F.lit(0)).alias("counts"))
    state = let(state, lambda s: F.when(F.size(s["names"]) > 0, _masked(s, alone(s["names"]), "[NAME]")).otherwise(none(s)))
    return let(state, lambda s: F.struct(F.when(_holds(s["text"], ("  ", "\t", "\n\n\n")), _squeezed(s["text"])).otherwise(s["text"]).alias("text"), F.map_from_arrays(F.array(*map(F.lit, KINDS)), s["counts"]).alias("counts")))


def mask_numbers(c: Column) -> Column:
    """H7. Text with the kinds of PII alone masked, for pages of no single person; runs of blanks become one. Null: empty."""
    text = F.coalesce(c, F.lit(""))
    for _, pattern, mark in PII:
        text = F.regexp_replace(text, pattern, mark)
    return _squeezed(text)


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def residual_pii(c: Column) -> Column:
    """H6. Kinds of personal data still there."""
    return F.array_compact(F.array(*(F.when(_maybe(c, *MAYBE.get(k, ((), ""))) & c.rlike(p), F.lit(k)) for k, p, _ in PII)))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """H37. Decoded JSON, or the default where it is null or malformed."""
    return F.coalesce(F.from_json(c, schema), default)


def grade(score: Column) -> Column:
    """H38. A name for a score."""
    return F.when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "fair").when(score >= 60, "pass").otherwise("weak")


def label(c: Column, names: Mapping[str, str]) -> Column:
    """H38. The name for a code; the code where there is none."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), c), c)


def word_parts(pattern: str) -> tuple[bool, tuple[str, ...]]:
    """Of a pattern that is a list of words, `\\b(as|bs?)\\b` or `^(as|bs?)\\b`: whether a text must start with one of them, and parts of which it then must hold (or start with) one. None for other patterns."""
    found = re.fullmatch(r"(\\b|\^)\(((?:[a-z0-9]\??|\|)+)\)\\b", pattern)
    if not found:
        return False, ()
    starts = found[1] == "^"
    pieces = [re.split(r"[a-z0-9]\?", word) for word in found[2].split("|")]
    parts = tuple(p[0] if starts else max(p, key=len) for p in pieces)
    return starts, parts if all(parts) else ()


def meets(low: Column, pattern: str) -> Column:
    """low.rlike(pattern); of a list of words the parts are looked for first, which few lines hold and which cost less than a pattern."""
    starts, parts = word_parts(pattern)
    if not parts:
        return low.rlike(pattern)
    return reduce(or_, ((F.startswith if starts else F.contains)(low, F.lit(p)) for p in parts)) & low.rlike(pattern)


def line_class(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """H16. The first class whose pattern the line meets, else other."""
    return class_of(F.lower(c), rules)


def class_of(low: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """H16. As line_class, for a line in lower case."""
    out = F.lit("other")
    for name, pattern in reversed(rules):
        out = F.when(meets(low, pattern), name).otherwise(out)
    return out


def date_range(c: Column, as_of: str, strict_parity: bool = False) -> Column:
    """H27. start and end month (first days) and inclusive months of a range such as 2020.03-2021.06; present is `as_of`.

    A year alone starts in January and ends in December. With strict_parity an end month is never read.
    """
    pattern = r"(?i)([0-9]{4})(?:[./-]([0-9]{1,2}))?\s*(?:-|to|until)\s*(?:([0-9]{4})(?:[./-]([0-9]{1,2}))?|(present|now|today))"
    part = lambda i: F.regexp_extract(c, pattern, i)
    number = lambda i, other: F.when(part(i) != "", part(i).cast("int")).otherwise(F.lit(other))
    month = lambda m: F.least(F.greatest(m, F.lit(1)), F.lit(12))
    start = F.make_date(number(1, None), month(number(2, 1)), F.lit(1))
    end_month = F.lit(12) if strict_parity else month(number(4, 12))
    end = F.when(part(5) != "", F.trunc(F.lit(as_of).cast("date"), "month")).otherwise(F.make_date(number(3, None), end_month, F.lit(1)))
    months = F.when(end >= start, F.months_between(end, start).cast("int") + 1)
    return F.struct(start.alias("start"), end.alias("end"), months.alias("months"))


def target_position(c: Column) -> Column:
    """H33. The position that a text names, cleaned to three parts at most."""
    raw = F.regexp_extract(c, r"(?im)^(?:target|position|objective)\s*[:=]\s*(.{2,60})$", 1)
    return clean_target(raw)


def target_from_name(c: Column) -> Column:
    """H33. The position that a file's name gives: without suffix and numbers, three parts at most."""
    return clean_target(F.regexp_replace(F.regexp_replace(c, r"\.[A-Za-z]+$", ""), r"^~\$", ""))


def clean_target(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, r"[-_/|,\s]+"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^[0-9]+$"))
    return F.array_join(F.slice(parts, 1, 3), " ")
