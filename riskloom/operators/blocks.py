"""Function-block extraction (D3–D6) as relations of brackets and lines.

A small per-file helper blanks what is not code: comments become spaces,
characters of strings, templates and regex literals become ``x``, their line
breaks U+0001, so offsets stay. All else is windows over rows:

* JavaScript / TypeScript: a file is cut at brackets, ``=>``, ``,``, ``;`` and
  line breaks that may end a statement; such an event carries the text before
  it. A running sum gives each event's bracket depth, and the last opening
  bracket one level up is its scope. Within a scope an opening bracket's
  partner is the next event, and a function's parts (parameters, ``=>``, body)
  are neighbours, so leads and lags find its name and end.
* Python: a file is cut into logical lines (no break inside strings or
  brackets). A definition ends before the next line that is indented no deeper;
  the next line of each indentation is one window per (file, indentation).

Unbalanced code gives what its brackets or lines show; there is no failure per
file. Output per function: (ids, func_idx, name, start_line, end_line,
signature, body) with 1-based lines, ordered by start. The id columns must name
a file row uniquely.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

ANON = "<anonymous>"
_JOINED = "\x01"   # a line break inside a literal

# ---------------------------------------------------------------- masking ---
_PY_LITERAL = re.compile(r"""'{3}(?:\\.|.)*?(?:'{3}|\Z)|"{3}(?:\\.|.)*?(?:"{3}|\Z)|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|\#[^\n]*|\\\r?\n""", re.S)
_JS_LITERAL = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|`|(?:(?<=[=(,:;!&|?{}\[+\-*%<>~^\n])|\A|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|(?<=\bin)|(?<=\bof)|(?<=\bvoid)|(?<=\bdelete)|(?<=\bthrow)|(?<=\bawait)|(?<=\byield)|(?<=\belse))[ \t]*/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*""", re.S)
_TEMPLATE = re.compile(r"\\.|`|\$\{|\{|\}|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.S)


def _template_end(code: str, start: int) -> int:
    """End of the template literal that opens at ``start``; ``${}`` in it may hold templates again."""
    open_at, at = ["`"], start + 1
    while open_at and (m := _TEMPLATE.search(code, at)):
        text, at = m[0], m.end()
        if open_at[-1] == "`" and text[0] in "'\"{}":
            at = m.start() + 1   # plain text of the template
        elif text == "`":
            open_at.pop() if open_at[-1] == "`" else open_at.append("`")
        elif text in ("${", "{"):
            open_at.append("{")
        elif text == "}":
            open_at.pop()
    return at if not open_at else len(code)


def _blank(text: str) -> str:
    if text[0] in "#\\" or text.startswith(("//", "/*")):
        return re.sub(r"[^\n]", " ", text) if text[0] != "\\" else " " * (len(text) - 1) + _JOINED
    quoted = text[0] + "x" * (len(text) - 2) + text[-1] if len(text) > 1 else text
    return "".join(_JOINED if c == "\n" else q for c, q in zip(text, quoted))


def masked(code: str | None, python: bool) -> str | None:
    """``code`` with literals and comments blanked, length and line breaks kept (inside literals as U+0001)."""
    if code is None:
        return None
    out, at, literal = [], 0, _PY_LITERAL if python else _JS_LITERAL
    while m := literal.search(code, at):
        end = _template_end(code, m.start()) if m[0] == "`" and not python else m.end()
        skip = len(m[0]) - len(m[0].lstrip(" \t")) if m[0] != "`" else 0
        out += [code[at:m.start() + skip], _blank(code[m.start() + skip:end])]
        at = end
    return "".join([*out, code[at:]])


@F.pandas_udf(T.StringType())
def _masked(code: pd.Series, python: pd.Series) -> pd.Series:
    return pd.Series([masked(c, p) for c, p in zip(code, python)], dtype=object)


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


# ------------------------------------------------------------- JS / TS ------
# The text up to an event and the event; a line break counts where a statement may end.
_EVENT = r"(?s)(?:[^(){}\[\],;=\n]++|=(?!>)|\n(?!(?<=[\w$)\]}'\"`]\r?\n)[ \t\r\n]*+[A-Za-z_$@]))*+(?:=>|[(){}\[\],;\n])"
_MODS = r"(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract|accessor)\s+|\*\s*)*"
_NAME = r"[A-Za-z_$][\w$]*"
_METHOD = rf"^\s*(?:@[\w$.]+\s+)*({_MODS}({_NAME})(?:\s*<[^()]*>)?)\s*$"
_DECLARED = rf"^\s*(?:(?:export|default|declare)\s+)*((?:async\s+)?function\s+({_NAME})(?:\s*<[^()]*>)?)\s*$"
_CONTROL = ("if", "for", "while", "switch", "catch", "function", "return", "with", "await", "do", "else", "new", "typeof", "super")
_BARE = rf"((?:\basync\s+)?(?<![\w$.])({_NAME}))\s*$"                      # x => ...
_BEFORE_PARENS = r"((?:\basync\s*)?(?:<[^()]*>\s*)?)$"                       # async <T>(x) => ...
_ASSIGNED = rf"(?:^|[^.\w$])({_NAME})\s*(?::[^=;]*)?=\s*(?:\basync\s*)?(?:<[^()]*>\s*)?$"
_TYPED_NAME = rf"\b(?:const|let|var)\s+({_NAME})\s*:\s*$"
_TYPE_ONLY = r"(?:\b(?:const|let|var)\s+[\w$]+\s*:|\btype\s+[\w$]+(?:<[^=]*>)?\s*=|[|&]|\bas|\bimplements|\bextends)\s*(?:new\s*)?$"
_UNFINISHED = r"[:<|&,=(]\s*$"                                               # a brace here opens a type
_AHEAD = 7


def _events(files: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, kind, pre, off, level, scope, scope_pre): brackets and separators, in their scopes.

    ``off`` is 0-based; a scope is named by the offset of its opening bracket (-1: the file)."""
    seg = files.select(*ids, F.posexplode(F.regexp_extract_all("_masked", F.lit(_EVENT), F.lit(0))).alias("n", "seg"))
    w = Window.partitionBy(*ids).orderBy("n")
    kind = F.when(F.col("seg").endswith("=>"), "=>").otherwise(F.right("seg", F.lit(1)))
    seg = seg.withColumn("kind", kind).withColumn("pre", F.expr("left(seg, length(seg) - length(kind))"))
    seg = seg.withColumn("off", F.sum(F.length("seg")).over(w) - F.length("kind"))
    opens, closes = F.col("kind").isin("(", "{", "["), F.col("kind").isin(")", "}", "]")
    seg = seg.withColumn("level", F.sum(opens.cast("int") - closes.cast("int")).over(w) - opens.cast("int")).drop("n", "seg")
    # an opening bracket also marks the start of its scope, one level down
    mark = F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    x = seg.withColumn("mark", mark).withColumn("level", F.col("level") + F.col("mark").cast("int"))
    inside = Window.partitionBy(*ids, "level").orderBy("off", "mark")
    marked = lambda c: F.last(F.when(F.col("mark"), F.col(c)), ignorenulls=True).over(inside)
    x = x.withColumn("scope", F.coalesce(marked("off"), F.lit(-1))).withColumn("scope_pre", F.coalesce(marked("pre"), F.lit("")))
    return x.where(~F.col("mark")).drop("mark")


def _js_blocks(files: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, name, start, end): functions of JS / TS files, offsets 0-based, end exclusive."""
    w = Window.partitionBy(*ids, "scope").orderBy("off")
    ev = _events(files, ids)
    # commas of type parameters: name<A, B>( is one text
    b = [(F.lag("kind", i).over(w), F.lag("pre", i).over(w)) for i in (1, 2)]
    one, two = F.concat(b[0][1], F.lit(","), F.col("pre")), F.concat(b[1][1], F.lit(","), b[0][1], F.lit(","), F.col("pre"))
    tail = (F.col("kind") == "(") & F.col("pre").rlike(r"^[^<]*>\s*$") & (b[0][0] == ",")
    ev = ev.withColumn("pre", F.when(tail & b[0][1].contains("<"), one).when(tail & (b[1][0] == ",") & b[1][1].contains("<"), two).otherwise(F.col("pre")))
    here = F.struct("kind", "pre", "off")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    stop = F.min(F.when(F.col("kind").isin(",", ";", "\n"), F.col("off"))).over(after)
    ev = ev.select(*ids, "kind", "pre", "off", "scope", "scope_pre", stop.alias("stop"), F.lag(here, 1).over(w).alias("b1"), F.lag(here, 2).over(w).alias("b2"),
                   F.lag(here, 3).over(w).alias("b3"), F.lag(here, 5).over(w).alias("b5"), F.array_compact(F.array(*[F.lead(here, i).over(w) for i in range(1, _AHEAD + 1)])).alias("next"))

    # declarations and methods: name ( ) [: type] { }
    rest = F.slice("next", 2, _AHEAD)
    is_body = lambda e: (e["kind"] == "{") & ~e["pre"].rlike(_UNFINISHED)
    at = F.array_position(F.transform(rest, is_body), True).cast("int")
    between = F.slice(rest, 1, F.greatest(at - 1, F.lit(0)))
    typed = (at == 1) & F.get(rest, F.lit(0))["pre"].rlike(r"^\s*(?::[\s\S]*)?$") | (at > 1) & F.get(rest, F.lit(0))["pre"].rlike(r"^\s*:") & F.forall(between, lambda e: e["kind"].isin(",", "{", "}", "[", "]"))
    head = F.when(F.col("pre").rlike(_DECLARED), F.regexp_extract("pre", _DECLARED, 1)).otherwise(F.regexp_extract("pre", _METHOD, 1))
    name = F.when(F.col("pre").rlike(_DECLARED), F.regexp_extract("pre", _DECLARED, 2)).otherwise(F.regexp_extract("pre", _METHOD, 2))
    calls = (ev.where((F.col("kind") == "(") & (F.get("next", F.lit(0))["kind"] == ")") & (F.col("pre").rlike(_DECLARED) | F.col("pre").rlike(_METHOD)))
             .withColumn("name", name).withColumn("head", head).where(~F.col("name").isin(*_CONTROL)).withColumn("at", at).where((F.col("at") > 0) & typed)
             .withColumn("end", F.get(rest, F.col("at"))["off"] + 1)
             .withColumn("start", F.expr("off - length(pre) + locate(head, pre) - 1")))

    # arrows: ( ) [: type] => body, or x => body
    arrows = ev.where(F.col("kind") == "=>")
    parens = F.coalesce((F.col("b1.kind") == ")") & F.col("pre").rlike(r"^\s*(?::[\s\S]*)?$"), F.lit(False))
    opener = F.col("b2.pre")
    # in ``f: (a) => T = (x) => ...`` the name stands before the type
    assigned = F.when((F.col("b3.kind") == "=>") & F.col("b5.pre").rlike(_TYPED_NAME), F.regexp_extract("b5.pre", _TYPED_NAME, 1)).otherwise(F.regexp_extract(opener, _ASSIGNED, 1))
    field = F.col("scope_pre").rlike(r"\bclass\b") & ~opener.rlike(r"\b(?:const|let|var)\s")
    arrows = arrows.withColumn("parens", parens).where(F.when(F.col("parens"), ~opener.rlike(_TYPE_ONLY)).otherwise(F.col("pre").rlike(_BARE)))
    arrows = arrows.withColumn("name", F.when(~F.col("parens"), F.regexp_extract("pre", _BARE, 2)).when((assigned == "") | field, ANON).otherwise(assigned))
    arrows = arrows.withColumn("start", F.when(F.col("parens"), F.col("b2.off") - F.length(F.regexp_extract(opener, _BEFORE_PARENS, 1)))
                               .otherwise(F.expr("off - length(pre)") + F.length(F.regexp_replace("pre", _BARE, ""))))
    first = F.get("next", F.lit(0))
    block = (first["kind"] == "{") & (F.trim(first["pre"]) == "") & F.get("next", F.lit(1)).isNotNull()
    ends = ev.where(F.col("kind").isin("(", "{", "[")).select(*ids, F.col("off").alias("scope"), F.get("next", F.lit(0))["off"].alias("closes"))
    arrows = (arrows.withColumn("end", F.when(F.coalesce(block, F.lit(False)), F.get("next", F.lit(1))["off"] + 1)).join(ends.hint("merge"), [*ids, "scope"], "left")
              .withColumn("end", F.coalesce("end", F.least("stop", "closes"))))
    cols = [*ids, "name", "start", "end"]
    return calls.select(*cols).unionByName(arrows.select(*cols))


# ---------------------------------------------------------------- Python ----
_DEF = r"^([ \t]*)(?:async[ \t]+)?def[ \t]+((?U)\w+)"


def _py_blocks(files: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, name, start, end): functions of Python files, offsets 0-based, end exclusive."""
    w = Window.partitionBy(*ids).orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = files.select(*ids, F.posexplode(F.split("_masked", "\n", -1)).alias("n", "line"))
    net = F.length(F.translate("line", ")]}", "")) - F.length(F.translate("line", "([{", ""))
    x = (x.withColumn("off", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
          .withColumn("depth", F.coalesce(F.sum(net).over(before), F.lit(0)))
          .withColumn("code", F.regexp_replace("line", rf"[\s{_JOINED}]+$", "")).where(F.col("code") != ""))
    indent = F.regexp_extract("code", r"^([ \t]*)", 1)
    x = x.withColumn("indent", F.when(F.col("depth") <= 0, F.length(F.replace(indent, F.lit("\t"), F.lit(" " * 8)))))
    # where the code before this line ends
    x = x.withColumn("ended", F.lag(F.col("off") + F.length("code")).over(w))
    lines = x.where(F.col("indent").isNotNull())
    last = x.groupBy(*ids).agg(F.max(F.col("off") + F.length("code")).alias("last"))
    levels = lines.groupBy(*ids).agg(F.collect_set("indent").alias("levels"))   # a few per file
    defs = lines.where(F.col("code").rlike(_DEF)).withColumn("name", F.regexp_extract("code", _DEF, 2)).withColumn("start", F.col("off") + F.length(indent))
    asks = (defs.join(levels.hint("merge"), ids).withColumn("level", F.explode(F.filter("levels", lambda v: v <= F.col("indent"))))
            .select(*ids, "level", "n", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("ended"), "name", "start"))
    told = lines.select(*ids, F.col("indent").alias("level"), "n", F.lit(False).alias("asks"), F.col("ended").cast("long").alias("ended"))
    both = told.unionByName(asks, allowMissingColumns=True)
    # the next line of that indentation: from the last line up, a line asks before it is told of
    at = Window.partitionBy(*ids, "level").orderBy(F.desc("n"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(~F.col("asks"), F.struct("n", "ended")), ignorenulls=True).over(at)
    found = both.withColumn("next", nxt).where("asks")
    best = found.groupBy(*ids, "n", "name", "start").agg(F.min("next").alias("next"))
    return best.join(last.hint("merge"), ids).select(*ids, "name", "start", F.coalesce("next.ended", "last").alias("end"))


def function_blocks(files: DataFrame, id_cols: list[str], *, path_col: str = "file_path",
                    content_col: str = "file_content", profile: str = "backend", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every function of every file of a known language, one output row per function, with the file's ``keep`` columns."""
    ids = list(id_cols)
    keep = [c for c in keep if c not in ids]
    lang = S.detect_language(path_col, profile)
    src = (files.select(*ids, *keep, F.col(content_col).alias("_code"), lang.alias("_lang"))
                .where(F.col("_lang").isin("python", "javascript", "typescript", "tsx", "jsx") & F.col("_code").isNotNull()))
    # one exchange by file serves all windows and joins; a fixed count, as a small file table is much work
    src = src.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ids)
    code = src.select(*ids, (F.col("_lang") == "python").alias("_py"), _masked("_code", F.col("_lang") == "python").alias("_masked"))
    found = _py_blocks(code.where("_py"), ids).unionByName(_js_blocks(code.where("not _py"), ids))
    body = F.expr("substring(_code, start + 1, coalesce(end, length(_code)) - start)")
    # all sides lie by file already: merged there. Estimates know nothing of the length of the texts, so
    # without the hint whole files are taken for a small table and sent through the driver
    x = found.join(src.select(*ids, *keep, "_code").hint("merge"), ids).withColumn("body", F.regexp_replace(body, r"\s+$", ""))
    x = x.withColumn("start_line", (1 + _breaks(F.expr("left(_code, start)"))).cast("int"))
    x = x.withColumn("end_line", (F.col("start_line") + _breaks(F.col("body"))).cast("int"))
    order = Window.partitionBy(*ids).orderBy("start", F.desc("end"))
    return x.select(*ids, *keep, (F.row_number().over(order) - 1).alias("func_idx"), "name", "start_line", "end_line",
                    F.trim(F.substring_index("body", "\n", 1)).alias("signature"), "body")
