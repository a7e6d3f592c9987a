"""Markdown block grammar (K1): a line automaton whose line maps compose.

Every line gets a class from its own text (and, for a table head, the line after it). A class is a map from
states to states: which block, if any, is open after the line, whether the line starts a block and whether it belongs to one.
Such maps compose associatively, so the lines of a document are scanned in pieces of ``PIECE`` lines: each piece is folded to
one map from all states, the entry states follow from the pieces' maps, and within a piece the lines are walked from
its entry state. All of it is column expressions within the document's row, linear in its lines.

Blocks: ATX and setext headings, thematic breaks, fenced and indented code, lists (items of one marker, with their
indented lines and blank lines between), tables (a line with ``|`` before a delimiter row, then lines with ``|``), HTML (block tags and
lone tags to the next blank line, comments and raw tags to their end), quotes with lazy lines, paragraphs. Not
covered: containers within containers are text of the outer block, reference definitions are paragraphs, and marks of
a fence beyond eight count as eight.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 256
LONGEST_FENCE = 8

# Fixed values of the CommonMark specification: tags that start an HTML block, tags whose content is raw.
HTML_BLOCK_TAGS = ("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
                   "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li "
                   "link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot "
                   "th thead title tr track ul").split()
HTML_RAW_TAGS = ("pre", "script", "style", "textarea")
BULLETS, ORDERED = "-+*", ".)"

_TAG = r"</?[A-Za-z][\w-]*(\s+[\w:-]+(\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>"
_RAW = "(" + "|".join(HTML_RAW_TAGS) + ")"


def _fences() -> list[tuple[str, int]]:
    return [(mark, n) for mark in "`~" for n in range(3, LONGEST_FENCE + 1)]


#: Line classes with their patterns, first to last; a line of none is text. ``code`` is four columns of indent.
_LINES: list[tuple[str, str]] = [
    ("blank", r"^[ \t]*$"),
    *((f"fence{mark}{n}", rf"^ {{0,3}}{mark}{{{n}{',' if n == LONGEST_FENCE else ''}}}(?!{mark})[ \t]*$") for mark, n in _fences()),
    *((f"open{mark}{n}", rf"^ {{0,3}}{mark}{{{n}{',' if n == LONGEST_FENCE else ''}}}(?!{mark}){'[^`]*' if mark == '`' else '.*'}$")
      for mark, n in _fences()),
    ("code", r"^( {4}| {0,3}\t)"),
    ("heading", r"^ {0,3}#{1,6}([ \t]|$)"),
    ("dashes", r"^ {0,3}-{3,}[ \t]*$"),
    ("break", r"^ {0,3}((\*[ \t]*){3,}|(_[ \t]*){3,}|(-[ \t]*){3,})$"),
    ("equals", r"^ {0,3}(=+|-{1,2})[ \t]*$"),
    *((f"item{mark}", rf"^ {{0,3}}\{mark}[ \t]+\S") for mark in BULLETS),
    *((f"item{mark}", rf"^ {{0,3}}1\{mark}[ \t]+\S") for mark in ORDERED),
    *((f"weak{mark}", rf"^ {{0,3}}\{mark}([ \t]|$)") for mark in BULLETS),
    *((f"weak{mark}", rf"^ {{0,3}}\d{{1,9}}\{mark}([ \t]|$)") for mark in ORDERED),
    ("quote", r"^ {0,3}>"),
    ("comment1", r"^ {0,3}<!--.*-->"),
    ("comment", r"^ {0,3}<!--"),
    ("raw1", rf"(?i)^ {{0,3}}<{_RAW}(\s|>|$).*</{_RAW}>"),
    ("raw", rf"(?i)^ {{0,3}}<{_RAW}(\s|>|$)"),
    ("html", r"(?i)^ {0,3}(</?(" + "|".join(HTML_BLOCK_TAGS) + r")(\s|/?>|$)|<[?!])"),
    ("tag", rf"^ {{0,3}}{_TAG}[ \t]*$"),
]
_CLASSES = [name for name, _ in _LINES] + ["head", "text"]
#: What else a line may be, whatever its class: a table row, the end of a comment or of a raw tag, indented under a bullet or
#: a number.
_TRAITS = (("row", r"\|"), ("ends", "-->"), ("closes", rf"(?i)</{_RAW}>"), ("deep2", r"^( {2}| ?\t)"), ("deep3", r"^( {3}| {0,2}\t)"))
_DELIMITER = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"

_STATES = ["none", "paragraph", "quote", "table", "html", "comment", "raw", "code", "code?", *(
    f"list{m}{q}" for m in BULLETS + ORDERED for q in ("", "?")), *(f"fence{m}{n}" for m, n in _fences())]
#: The kind of the block that a line of a class starts, where it isn't the class itself.
_KINDS = {"open": "code", "fence": "code", "item": "list", "weak": "list", "dashes": "break", "comment1": "html", "comment": "html", "raw1": "html",
          "raw": "html", "tag": "html", "head": "table", "equals": "paragraph", "text": "paragraph"}
KINDS = ("heading", "break", "code", "list", "quote", "table", "html", "paragraph")
_INTERRUPTS = ("heading", "break", "dashes", "quote", "comment1", "comment", "raw1", "raw", "html", "head")


def _kind(cls: str) -> str:
    return next((k for name, k in _KINDS.items() if cls.startswith(name) and (name in ("open", "fence", "item", "weak") or cls == name)), cls)


def _opened(cls: str) -> str:
    """The state after a line of a class has started a block."""
    if cls[:4] == "open" or cls[:5] == "fence":
        return "fence" + cls.removeprefix("open").removeprefix("fence")
    if cls[:4] in ("item", "weak"):
        return "list" + cls[4:]
    if cls in ("heading", "break", "dashes", "comment1", "raw1"):
        return "none"
    return {"tag": "html", "head": "table", "equals": "paragraph", "text": "paragraph"}.get(cls, cls)


def _after(state: str, cls: str) -> tuple[str, bool, bool]:
    """(state after a line without traits, whether it starts a block, whether it belongs to one)."""
    start = _opened(cls), True, True
    interrupts = cls in _INTERRUPTS or cls[:4] in ("open", "item") or cls[:5] == "fence"
    if state.startswith("fence"):
        mark, n = state[5], int(state[6:])
        ends = cls[:5] == "fence" and cls[5] == mark and int(cls[6:]) >= n
        return "none" if ends else state, False, True
    if state in ("comment", "raw"):
        return state, False, True
    if state == "html":
        return ("none", False, False) if cls == "blank" else (state, False, True)
    if state.startswith("list"):
        mark, waits = state[4], state.endswith("?")
        if cls == "blank":
            return f"list{mark}?", False, True
        if cls == "code" or cls[:4] in ("item", "weak") and cls[4] == mark:
            return f"list{mark}", False, True
        lazy = not waits and not interrupts and cls[:4] != "weak"
        return (state, False, True) if lazy else start
    if cls == "blank":
        return ("code?", False, True) if state.startswith("code") else ("none", False, False)
    if state.startswith("code"):
        return ("code", False, True) if cls == "code" else start
    if state == "table":
        return start
    if state == "quote":
        return (state, False, True) if cls == "quote" or not interrupts and cls[:4] != "weak" else start
    if state == "paragraph":
        if cls in ("equals", "dashes"):
            return "none", False, True
        return start if interrupts else (state, False, True)
    return start


@functools.cache
def _table() -> list[int]:
    """The maps of the classes: at class * states + state stands 4 * state after + 2 * starts + belongs."""
    found = [_after(state, cls) for cls in _CLASSES for state in _STATES]
    return [4 * _STATES.index(after) + 2 * starts + belongs for after, starts, belongs in found]


def _literal(values: list) -> Column:
    """An array from one string literal, folded when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def _line_class(line: Column, after: Column) -> Column:
    """The number of a line's class, times the sets of traits, plus the number of its set."""
    number = F.lit(_CLASSES.index("text"))
    head = line.contains("|") & after.contains("|") & after.rlike(_DELIMITER)
    number = F.when(head, F.lit(_CLASSES.index("head"))).otherwise(number)
    for i in range(len(_LINES) - 1, -1, -1):
        number = F.when(line.rlike(_LINES[i][1]), F.lit(i)).otherwise(number)
    traits = F.lit(0)
    for i, (_, pattern) in enumerate(_TRAITS):
        traits = traits + F.when(line.rlike(pattern), F.lit(1 << i)).otherwise(F.lit(0))
    return number * (1 << len(_TRAITS)) + traits


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def typed_blocks(text: Column) -> Column:
    """``array<struct<kind, block>>``: the blocks of a Markdown text in order. A block is its lines as they stand, without blank
    lines at its end; a setext heading is of kind ``setext``. A null text has none."""
    table = _literal(_table()).cast("array<int>")
    n_states, n_sets = len(_STATES), 1 << len(_TRAITS)
    at = {state: i for i, state in enumerate(_STATES)}
    bullets, ordered, after = at[f"list{BULLETS[0]}"], at[f"list{ORDERED[0]}"], at[f"list{ORDERED[-1]}?"] + 1
    numbers = F.sequence(F.lit(0), F.lit(n_states - 1))
    kinds = _literal([_kind(c) for c in _CLASSES])

    def step(state: Column, line: Column) -> Column:
        """4 * state after + 2 * starts + belongs; the traits of a line speak before its class."""
        def has(name: str) -> Column:
            return line.bitwiseAND(1 << [n for n, _ in _TRAITS].index(name)) > 0
        deep = (state >= bullets) & (state < after) & F.when(state < ordered, has("deep2")).otherwise(has("deep3"))
        blank = line < n_sets * (_CLASSES.index("blank") + 1)
        return (F.when((state == at["table"]) & has("row"), F.lit(4 * at["table"] + 1))
                .when((state == at["comment"]) & has("ends") | (state == at["raw"]) & has("closes"), F.lit(4 * at["none"] + 1))
                .when(deep & ~blank, 4 * (state - (state - bullets) % 2) + 1)
                .otherwise(F.get(table, F.floor(line / n_sets).cast("int") * n_states + state)))

    def fold(lines: Column, classes: Column) -> Column:
        size = F.greatest(F.ceil(F.size(lines) / F.lit(PIECE)).cast("int"), F.lit(1))
        pieces = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.slice(classes, i * PIECE + 1, F.lit(PIECE)))
        whole = F.transform(pieces, lambda p: F.aggregate(p, numbers, lambda states, c: F.transform(
            states, lambda s: F.floor(step(s, c) / 4).cast("int"))))
        entry = F.aggregate(whole, F.array(F.lit(0)), lambda got, w: F.concat(got, F.array(F.get(w, F.element_at(got, -1)))))
        walked = F.zip_with(pieces, F.slice(entry, F.lit(1), size), lambda p, s: F.slice(F.aggregate(
            p, F.array(4 * s), lambda got, c: F.concat(got, F.array(step(F.floor(F.element_at(got, -1) / 4).cast("int"), c)))),
            F.lit(2), F.greatest(F.size(p), F.lit(0))))
        return F.flatten(walked)

    def cut(x: Column) -> Column:
        """The blocks of struct(lines, maps, marks)."""
        at = F.filter(F.transform(x["marks"], lambda m, i: F.when(m.bitwiseAND(2) > 0, i)), lambda i: i.isNotNull())
        return _once(F.struct(x.alias("x"), at.alias("at")), lambda y: F.transform(y["at"], lambda i, k: block(
            y["x"], i, F.coalesce(F.get(y["at"], k + 1), F.size(y["x"]["lines"])))))

    def block(x: Column, start: Column, end: Column) -> Column:
        lines, marks = F.slice(x["lines"], start + 1, end - start), F.slice(x["marks"], start + 1, end - start)
        own = F.filter(F.zip_with(lines, marks, lambda a, m: F.when(m.bitwiseAND(1) > 0, a)), lambda a: a.isNotNull())
        cls = F.floor(F.get(x["classes"], start) / n_sets).cast("int")
        kind = F.get(kinds, cls)
        last = F.element_at(own, -1)
        # a paragraph that an underline closed: the state after its last line is none
        closed = F.exists(F.zip_with(lines, marks, lambda a, m: (m.bitwiseAND(1) > 0) & (m < 4)), lambda c: c)
        kind = F.when((kind == "paragraph") & closed & last.rlike(r"^ {0,3}(=+|-+)[ \t]*$"), F.lit("setext")).otherwise(kind)
        return F.struct(kind.alias("kind"), F.regexp_replace(F.array_join(own, "\n"), r"(\n[ \t]*)+$", "").alias("block"))

    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)
    classed = _once(lines, lambda ls: F.struct(ls.alias("lines"), F.transform(ls, lambda line, i: _line_class(
        line, F.coalesce(F.get(ls, i + 1), F.lit("")))).alias("classes")))
    marked = _once(classed, lambda x: F.struct(x["lines"].alias("lines"), x["classes"].alias("classes"), fold(
        x["lines"], x["classes"]).alias("marks")))
    return _once(marked, cut)
