"""Each function as an SQL expression over SQL expressions, in the dialect of Spark ("spark") or DuckDB ("duck").

One definition serves the column builders and the SQL that results are checked against. Steps that are used several times
should be columns of their own (see rules.score), so that they are computed once.
"""

from __future__ import annotations

from millrace.functions import values as v

SPARK, DUCK = "spark", "duck"
CJK = {SPARK: "[^\\\\u4e00-\\\\u9fff]", DUCK: "[^\\x{4e00}-\\x{9fff}]"}
LETTER = {SPARK: "[^a-zA-Z]", DUCK: "[^a-zA-Z]"}
SPACE = {SPARK: "[\\\\s\\\\x1c-\\\\x1f\\\\x85\\\\p{Z}]+", DUCK: "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def num(x: float) -> str:
    return f"cast({x} as double)"


def array(e: str, items: list[str]) -> str:
    return f"array({', '.join(items)})" if e == SPARK else f"[{', '.join(items)}]"


def words(e: str, items: list[str]) -> str:
    return array(e, [text(x) for x in items])


def each(e: str, a: str, x: str, body: str) -> str:
    return f"transform({a}, {x} -> {body})" if e == SPARK else f"list_transform({a}, lambda {x}: {body})"


def where(e: str, a: str, x: str, body: str) -> str:
    return f"filter({a}, {x} -> {body})" if e == SPARK else f"list_filter({a}, lambda {x}: {body})"


def size(e: str, a: str) -> str:
    return f"size({a})" if e == SPARK else f"cast(len({a}) as int)"


def join(e: str, a: str, sep: str) -> str:
    return f"array_join({a}, {text(sep)})" if e == SPARK else f"array_to_string({a}, {text(sep)})"


def split(e: str, s: str, sep: str) -> str:
    """sep: one character that is no regex operator, or escaped here."""
    return f"split({s}, {text('[' + sep + ']')}, -1)" if e == SPARK else f"string_split({s}, {text(sep)})"


def head(e: str, a: str, n: int) -> str:
    return f"slice({a}, 1, {n})" if e == SPARK else f"{a}[1:{n}]"


def sub(e: str, s: str, pattern: str, to: str) -> str:
    return f"regexp_replace({s}, {text(pattern)}, {text(to)})" if e == SPARK else f"regexp_replace({s}, {text(pattern)}, {text(to)}, 'g')"


def strip(e: str, s: str, chars: str, side: str = "both") -> str:
    if e == DUCK:
        return f"{ {'both': 'trim', 'trailing': 'rtrim'}[side] }({s}, {text(chars)})"
    return f"trim({side} {text(chars)} from {s})"


def rounded(e: str, x: str, n: int = 4) -> str:
    return f"bround({x}, {n})" if e == SPARK else f"round_even({x}, {n})"


def has_any(s: str, items: list[str]) -> str:
    return "(" + " or ".join(f"contains({s}, {text(w)})" for w in items) + ")"


def normalize(e: str, s: str) -> str:
    """Null to empty, white space collapsed, trimmed."""
    return f"trim({sub(e, f"coalesce({s}, '')", SPACE[e], ' ')})"


def clean_summary(e: str, s: str) -> str:
    return normalize(e, f"replace(replace({normalize(e, s)}, 'wan全', '完全'), 'BRAND', '')")


def only(e: str, s: str, others: dict = CJK) -> str:
    """The characters of a class alone (CJK by default)."""
    return sub(e, s, others[e], "")


def class_ratio(e: str, s: str, others: dict = CJK) -> str:
    plain = sub(e, f"coalesce({s}, '')", SPACE[e], "")
    return f"case when length({plain}) = 0 then {num(0)} else cast(length({only(e, plain, others)}) as double) / length({plain}) end"


def length_score(n: str) -> str:
    """n: characters of the class."""
    return f"case when {n} = 0 then {num(0)} when {n} between 60 and 160 then {num(1)} when {n} < 60 then exp(-(60 - {n}) / {num(35)}) else exp(-({n} - 160) / {num(35)}) end"


def grams(e: str, s: str, n: int = 3) -> str:
    """n-grams of a string's characters; an array of characters, not substrings, keeps this linear in Spark."""
    if e == SPARK:
        chars = f"split({s}, '')"
        body = " || ".join(f"get(ch, i + {j})" for j in range(n))
        return f"flatten(transform(array({chars}), ch -> case when length({s}) >= {n} then transform(sequence(0, length({s}) - {n}), i -> {body}) else array() end))"
    return f"list_transform(range(1, length({s}) - {n - 2}), lambda i: substr({s}, i, {n}))"


def repetition(e: str, g: str) -> str:
    """Share of n-grams that repeat an earlier one; g: array of n-grams."""
    distinct = f"size(array_distinct({g}))" if e == SPARK else f"len(list_distinct({g}))"
    return f"case when {size(e, g)} = 0 then {num(0)} else cast({size(e, g)} - {distinct} as double) / {size(e, g)} end"


def repeated_phrase(e: str, s: str) -> str:
    """Two to six characters, three times in a row or more."""
    if e == SPARK:
        return f"{s} rlike '(.{{2,6}})\\\\1{{2,}}'"
    one = lambda n: f"len(list_filter(range(1, length({s}) - {3 * n - 2}), lambda i: substr({s}, i, {n}) = substr({s}, i + {n}, {n}) and substr({s}, i, {n}) = substr({s}, i + {2 * n}, {n}) and not contains(substr({s}, i, {n}), chr(10)) and not contains(substr({s}, i, {n}), chr(13)))) > 0"
    return "(" + " or ".join(one(n) for n in range(2, 7)) + ")"


def word_list(e: str, s: str) -> str:
    if e == SPARK:
        return f"regexp_extract_all({s}, '[\\\\u4e00-\\\\u9fffA-Za-z0-9]{{2,}}', 0)"
    return f"regexp_extract_all({s}, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]{{2,}}')"


def frequent_share(e: str, w: str) -> str:
    """Share of words that occur three times or more; w: array of words."""
    if e == SPARK:
        # sorted, a word with another two places on is one of three
        s = "s"
        often = f"size(filter({s}, (x, i) -> x = get({s}, i + 2) or x = get({s}, i - 2) or (x = get({s}, i - 1) and x = get({s}, i + 1))))"
        count = f"get(transform(array(array_sort({w})), s -> {often}), 0)"
    else:
        count = f"len(list_filter({w}, lambda x: len(list_filter({w}, lambda y: y = x)) >= 3))"
    return f"case when {size(e, w)} < 6 then {num(0)} else cast({count} as double) / {size(e, w)} end"


def attr_segments(e: str, s: str, ascii_marks: bool = True) -> str:
    t = normalize(e, s)
    if ascii_marks:
        t = f"replace(replace({t}, ';', '；'), ':', '：')"
    at = f"instr({t}, '{v.PREFIX}')"
    body = f"case when {at} > 0 then substr({t}, {at} + {len(v.PREFIX)}) else {t} end"
    trimmed = each(e, split(e, strip(e, f"({body})", "。.", "trailing"), "；"), "x", "trim(x)")
    return where(e, trimmed, "x", "contains(x, '=')")


def segment_values(e: str, segments: str) -> str:
    """Values of 'key=value' segments, duplicates kept."""
    return where(e, each(e, segments, "x", "trim(substr(x, instr(x, '=') + 1))"), "x", "x <> ''")


def attr_values(e: str, s: str, ascii_marks: bool = True) -> str:
    return segment_values(e, attr_segments(e, s, ascii_marks))


def attr(e: str, s: str, key: str) -> str:
    return segment_value(e, attr_segments(e, s), key)


def segment_value(e: str, segments: str, key: str) -> str:
    """Last non-empty value of a key, or ''."""
    match = where(e, segments, "x", f"trim(substr(x, 1, instr(x, '=') - 1)) = {text(key)} and trim(substr(x, instr(x, '=') + 1)) <> ''")
    last = f"try_element_at({match}, -1)" if e == SPARK else f"{match}[-1]"
    return f"coalesce(trim(substr({last}, instr({last}, '=') + 1)), '')"


def content_pairs(e: str, s: str) -> str:
    """'key=value' of each piece key#value of a content string, cut at the first #; empty sides dropped."""
    control = {SPARK: "[\\\\x00-\\\\x1f\\\\x7f]", DUCK: "[\\x{00}-\\x{1f}\\x{7f}]"}
    t = normalize(e, sub(e, f"coalesce({s}, '')", control[e], ""))
    pieces = where(e, split(e, t, "*"), "x", "instr(x, '#') > 0 and trim(substr(x, 1, instr(x, '#') - 1)) <> '' and trim(substr(x, instr(x, '#') + 1)) <> ''")
    return each(e, pieces, "x", "trim(substr(x, 1, instr(x, '#') - 1)) || '=' || trim(substr(x, instr(x, '#') + 1))")


def distinct_pairs(e: str, pairs: str) -> str:
    """A repeated key keeps its first place and its last value."""
    key = "substr(y, 1, instr(y, '=') - 1)"
    if e == SPARK:
        last = f"try_element_at(filter({pairs}, y -> {key} = k), -1)"
        return f"transform(array_distinct(transform({pairs}, y -> {key})), k -> {last})"
    first = f"list_filter({pairs}, lambda y, i: len(list_filter({pairs}[1:i-1], lambda z: {key.replace('y', 'z')} = {key})) = 0)"
    return f"list_transform({first}, lambda x: list_filter({pairs}, lambda y: {key} = {key.replace('y', 'x')})[-1])"


def format_attributes(e: str, pairs: str) -> str:
    return f"case when {size(e, pairs)} = 0 then '{v.PREFIX}无。' else '{v.PREFIX}' || {join(e, pairs, '；')} || '。' end"


def coverage(e: str, vals: str, target: str) -> str:
    return f"case when {size(e, vals)} = 0 or {target} = '' then {num(0)} else cast({size(e, where(e, vals, 'x', f'contains({target}, x)'))} as double) / {size(e, vals)} end"


def forbidden(e: str, target: str) -> str:
    return where(e, words(e, v.FORBIDDEN), "x", f"contains(lower({target}), x)")


def _first_other(items: dict[str, list[str]], own: str, target: str) -> str:
    some = " ".join(f"when {own} <> {text(k)} and {has_any(target, a)} then {text(k)}" for k, a in items.items())
    return f"case {some} end"


def conflicts(e: str, kind: str, colour: str, material: str, target: str) -> str:
    """Texts of the type, colour and material conflicts, one of each at most; kind, colour, material: the input's values."""
    other = _first_other(v.TYPES, kind, target)
    present = "(" + " or ".join(f"({kind} = {text(k)} and {has_any(target, a)})" for k, a in v.TYPES.items()) + ")"
    of_type = f"case when {kind} in ({', '.join(map(text, v.TYPES))}) then case when {present} then '类型冲突: 输入=' else '类型疑似冲突: 输入=' end || {kind} || ', 文案出现=' || {other} end"
    found = _first_other({c: [c] for c in v.COLOURS}, colour, target)
    of_colour = (
        f"case when {colour} = '深色' then case when {has_any(target, ['白色', '浅色'])} then '颜色冲突: 输入=深色, 文案出现=白色/浅色' end "
        f"when {colour} = '浅色' then case when {has_any(target, ['黑色', '深色'])} then '颜色冲突: 输入=浅色, 文案出现=黑色/深色' end "
        f"when {colour} in ({', '.join(map(text, v.COLOURS))}) then '颜色冲突: 输入=' || {colour} || ', 文案出现=' || {found} end"
    )
    worn = _first_other({m: [m] for m in v.MATERIALS}, material, target)
    of_material = f"case when {material} in ({', '.join(map(text, v.MATERIALS))}) then '材质冲突: 输入=' || {material} || ', 文案出现=' || {worn} end"
    return f"case when {target} = '' then {where(e, words(e, ['']), 'x', 'false')} else {where(e, array(e, [of_type, of_colour, of_material]), 'x', 'x is not null')} end"


def total_score(cov: str, len_score: str, rep: str, forb: str, conf: str) -> str:
    raw = f"5 * ({num(0.45)} * {cov} + {num(0.25)} * {len_score} - {num(0.15)} * {rep} - {num(0.15)} * least({num(1)}, {forb} / {num(3)}) - {num(0.2)} * least({num(1)}, {conf} / {num(2)}))"
    return f"greatest({num(0)}, least({num(5)}, {raw}))"


def without(t: str, vals: list[str]) -> str:
    for x in vals:
        t = f"replace({t}, {x}, '')"
    return t


def weaken(e: str, reference: str, vals: str, slots: int = 8) -> str:
    """Every second value of two characters or more removed, then tidied; slots: places of values looked at in SQL text."""
    t = normalize(e, reference)
    if e == SPARK:
        cut = f"aggregate(filter({vals}, (x, i) -> i % 2 = 0 and length(x) >= 2), {t}, (acc, x) -> replace(acc, x, ''))"
    else:
        cut = without(t, [f"(case when length(coalesce({vals}[{i}], '')) >= 2 then {vals}[{i}] else chr(1) end)" for i in range(1, 2 * slots, 2)])
    tidy = strip(e, sub(e, cut, "[，。；]{2,}", "。"), "，。； ")
    return f"case when {t} = '' then '{v.WEAK_EMPTY}' else {closed(f'case when length({tidy}) < 20 then {text(v.WEAK_SHORT)} else {tidy} end')} end"


def some_values(e: str, vals: str, n: int, default: str) -> str:
    return f"case when {size(e, vals)} > 0 then {join(e, head(e, vals, n), '、')} else {text(default)} end"


def base_text(e: str, reference: str, vals: str, slots: int = 8) -> str:
    """A weak system's text: every second value of two characters or more removed; slots as in weaken()."""
    t = normalize(e, reference)
    if e == SPARK:
        cut = f"aggregate(filter({vals}, (x, i) -> i % 2 = 0 and length(x) >= 2), {t}, (acc, x) -> replace(acc, x, ''))"
    else:
        cut = without(t, [f"(case when length(coalesce({vals}[{i}], '')) >= 2 then {vals}[{i}] else chr(1) end)" for i in range(1, 2 * slots, 2)])
    bare = strip(e, f"({cut})", "，。； ")
    return closed(f"(case when length({bare}) < 18 then {text(v.BASE_SHORT)} else {bare} end)")


def sft_text(e: str, reference: str, vals: str) -> str:
    """The reference as it is, or a stock text of two values."""
    t = normalize(e, reference)
    return closed(f"(case when {t} = '' then '{v.SFT_EMPTY[0]}' || {some_values(e, vals, 2, '商品属性')} || '{v.SFT_EMPTY[1]}' else {t} end)")


def dpo_text(e: str, reference: str, vals: str) -> str:
    """The reference, or a stock text of three values, with up to three values that it doesn't show added."""
    t = normalize(e, reference)
    t = f"(case when {t} = '' then '{v.DPO_EMPTY[0]}' || {some_values(e, vals, 3, '核心卖点')} || '{v.DPO_EMPTY[1]}' else {t} end)"
    gone = where(e, vals, "x", f"not contains({t}, x)")
    return closed(f"({t} || case when {size(e, gone)} > 0 then '{v.DPO_ADDON[0]}' || {join(e, head(e, gone, 3), '、')} || '{v.DPO_ADDON[1]}' else '' end)")


def closed(t: str) -> str:
    """With a full stop at its end."""
    return f"(case when right({t}, 1) = '。' then {t} else ({t}) || '。' end)"


def exaggerate(e: str, reference: str) -> str:
    t = normalize(e, reference)
    return f"{closed(f'case when {t} = {text("")} then {text(v.EXAGGERATED_EMPTY)} else {t} end')} || '{v.EXAGGERATED_TAIL}'"


def generic(e: str, vals: str) -> str:
    return f"case when {size(e, vals)} = 0 then '{v.GENERIC_EMPTY}' else '{v.GENERIC[0]}' || {join(e, head(e, vals, 2), '、')} || '{v.GENERIC[1]}' end"


def shorten(s: str, n: int) -> str:
    return f"case when length({s}) > {n} then substr({s}, 1, {n}) || '...' else {s} end"
