"""Inline Markdown as native expressions: a text's runs with their formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.text import let

#: Code spans, escapes, delimiters, and text between them.
TOKEN = r"(`[^`]+`|\\.|\*{1,3}|_{1,3}|[^*_`\\]+|.)"
LINK = r"!?\[([^\]]*)\]\([^)]*\)"
BOLD, ITALIC = ("**", "__", "***", "___"), ("*", "_", "***", "___")


def _delimiter(t: Column) -> Column:
    return t.isin("*", "**", "***", "_", "__", "___")


def _tokens(text: Column) -> Column:
    """Tokens with their places, and whether a delimiter may open or close: it stands at a visible character, and `_` not inside a word."""
    cut = F.regexp_extract_all(F.regexp_replace(text, LINK, "$1"), F.lit(TOKEN), F.lit(1))

    def mark(all_: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before, after = F.coalesce(F.right(F.get(all_, i - 1), F.lit(1)), F.lit(" ")), F.coalesce(F.left(F.get(all_, i + 1), F.lit(1)), F.lit(" "))
            seen, word = (lambda c: ~c.rlike(r"^\s$")), (lambda c: c.rlike(r"^[\p{L}\p{N}]$"))
            under = t.startswith("_")
            return F.struct(i.alias("i"), t.alias("t"), (_delimiter(t) & seen(after) & ~(under & word(before))).alias("opens"), (_delimiter(t) & seen(before) & ~(under & word(after))).alias("closes"))

        return F.transform(all_, one)

    return let(cut, mark)


def inline_runs(text: Column) -> Column:
    """Array of (text, bold, italic, code) of a Markdown line.

    A delimiter stack is folded over the tokens: a closing delimiter pairs with the nearest open one of its kind, and
    those opened in between, like those never closed, are text.  `***` pairs with `***` alone.  Links and images give their text.
    """
    stack_type, pair_type = "array<struct<i:int,m:string>>", "array<struct<a:int,b:int,m:string>>"
    start = F.struct(F.array().cast(stack_type).alias("stack"), F.array().cast(pair_type).alias("pairs"))

    def step(state: Column, tok: Column) -> Column:
        stack, pairs = state["stack"], state["pairs"]
        open_ = F.filter(stack, lambda s: s["m"] == tok["t"])
        opener = F.get(open_, F.size(open_) - 1)
        paired = F.struct(F.filter(stack, lambda s: s["i"] < opener["i"]).alias("stack"), F.concat(pairs, F.array(F.struct(opener["i"].alias("a"), tok["i"].alias("b"), tok["t"].alias("m")))).alias("pairs"))
        pushed = F.struct(F.concat(stack, F.array(F.struct(tok["i"].alias("i"), tok["t"].alias("m")))).alias("stack"), pairs.alias("pairs"))
        return F.when(tok["closes"] & (F.size(open_) > 0), paired).when(tok["opens"], pushed).otherwise(state)

    def runs(tokens: Column) -> Column:
        return let(F.aggregate(tokens, start, step)["pairs"], lambda pairs: formatted(tokens, pairs))

    def formatted(tokens: Column, pairs: Column) -> Column:
        inside = lambda t, kinds: F.exists(pairs, lambda p: (p["a"] < t["i"]) & (t["i"] < p["b"]) & p["m"].isin(*kinds))
        code = lambda t: t["t"].rlike("^`[^`]+`$")
        own = lambda t: F.when(code(t), F.regexp_replace(t["t"], "`", "")).when(t["t"].rlike(r"^\\."), F.substring(t["t"], 2, 1)).otherwise(t["t"])
        kept = F.filter(tokens, lambda t: ~F.exists(pairs, lambda p: (p["a"] == t["i"]) | (p["b"] == t["i"])))
        pieces = F.transform(kept, lambda t: F.struct(own(t).alias("text"), inside(t, BOLD).alias("bold"), inside(t, ITALIC).alias("italic"), code(t).alias("code")))
        none = F.array().cast("array<struct<text:string,bold:boolean,italic:boolean,code:boolean>>")

        def joined(out: Column, piece: Column) -> Column:
            last = F.get(out, F.size(out) - 1)
            same = F.coalesce((last["bold"] == piece["bold"]) & (last["italic"] == piece["italic"]) & (last["code"] == piece["code"]), F.lit(False))
            longer = F.struct(F.concat(last["text"], piece["text"]).alias("text"), piece["bold"].alias("bold"), piece["italic"].alias("italic"), piece["code"].alias("code"))
            return F.when(same, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(piece)))

        return F.aggregate(pieces, none, joined)

    return let(_tokens(F.coalesce(text, F.lit(""))), runs)
