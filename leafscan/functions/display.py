"""How sizes, costs, tokens and states are shown as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
#: Fixed value: kinds of output, in the order they are listed.
OUTPUTS = ("txt", "hocr", "alto", "pdf")


def byte_size(n: Column) -> Column:
    """Bytes as the service shows them: whole bytes, else one decimal, half to even."""
    out = F.format_string("%.1f TB", F.rint(n / float(1024**4) * 10) / 10)
    for k in (3, 2, 1):
        out = F.when(n / float(1024**k) < 1024, F.format_string(f"%.1f {UNITS[k]}", F.rint(n / float(1024**k) * 10) / 10)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def upload_size(n: Column) -> Column:
    """Bytes as the page shows them: one decimal below 10, else whole, halves up; nothing is 0 B."""
    n = F.coalesce(n, F.lit(0)).cast("double")

    def shown(k: int) -> Column:
        v = n / float(1024**k)
        return F.when(v < 10, F.format_string(f"%.1f {UNITS[k]}", F.floor(v * 10 + 0.5) / 10.0)).otherwise(F.format_string(f"%d {UNITS[k]}", F.floor(v + 0.5).cast("long")))

    out = shown(4)
    for k in (3, 2, 1):
        out = F.when(n / float(1024**k) < 1024, shown(k)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def cost_text(cost: Column) -> Column:
    """Below a dollar cents with one decimal, else dollars with two; nothing for null."""
    cents = F.format_string("%.1f¢", F.floor(cost * 100 * 10 + 0.5) / 10.0)
    dollars = F.format_string("$%.2f", F.floor(cost * 100 + 0.5) / 100.0)
    return F.when(cost.isNull(), F.lit("")).when(cost < 1, cents).otherwise(dollars)


def token_text(n: Column) -> Column:
    return F.format_number(F.coalesce(n, F.lit(0)).cast("long"), 0)


def token_summary(total: Column, tokens_in: Column, out: Column, thinking: Column, calls: Column) -> Column:
    thought = F.when(F.coalesce(thinking, F.lit(0)) != 0, F.concat(F.lit(" (incl. "), token_text(thinking), F.lit(" thinking)"))).otherwise("")
    called = F.when(F.coalesce(calls, F.lit(0)) != 0, F.concat(token_text(calls), F.when(calls == 1, " API call").otherwise(" API calls")))
    return F.concat_ws(" · ", F.concat(token_text(total), F.lit(" tokens")), F.concat(token_text(tokens_in), F.lit(" in / "), token_text(out), F.lit(" out"), thought), called)


def price_text(rate_in: Column, rate_out: Column) -> Column:
    return F.format_string("$%.2f/1M input and $%.2f/1M output", F.coalesce(rate_in, F.lit(0.0)), F.coalesce(rate_out, F.lit(0.0)))


def estimate_text(files: Column, pages: Column, calls: Column, cost_low: Column, cost_high: Column, total_low: Column, total_high: Column) -> Column:
    """One line on what a run would take: nothing billed, a range of costs, or one of tokens where there is no price."""
    nothing = F.format_string("No API cost for these %d file(s).", files)
    ends = lambda a, b: F.concat(a, F.lit(" to "), b)
    over = F.concat(F.lit(" for "), token_text(pages), F.lit(" page(s)."))
    cost = F.concat(F.lit("Estimated cost "), ends(cost_text(cost_low), cost_text(cost_high)), over)
    tokens = F.concat(F.lit("Estimated "), ends(token_text(total_low), token_text(total_high)), F.lit(" tokens"), over)
    return F.when(F.coalesce(calls, F.lit(0)) == 0, nothing).when(cost_low.isNotNull(), cost).otherwise(tokens)


def status_class(code: Column) -> Column:
    return F.when(code.between(200, 399), "ok").when(code.between(400, 499), "warn").when(code >= 500, "err").otherwise("")


def mode_label(content: Column, mode: Column, refine: Column) -> Column:
    """text, else content/mode, with +wordboxes where words are refined; mixed content is handwriting with refined words."""
    mixed = content == "mixed"
    content = F.when(mixed, "handwriting").otherwise(F.coalesce(F.when(content != "", content), F.lit("handwriting")))
    refined = F.coalesce(mixed, F.lit(False)) | F.coalesce(refine, F.lit(False))
    return F.when(content == "text", "text").otherwise(F.concat(content, F.lit("/"), mode, F.when(refined, "+wordboxes").otherwise("")))


def wanted_outputs(asked: Column) -> Column:
    """The kinds of output asked for, in their order; all of them if none that exists is."""
    every = F.array(*map(F.lit, OUTPUTS))
    own = F.array_intersect(every, F.coalesce(asked, F.array().cast("array<string>")))
    return F.when(F.size(own) > 0, own).otherwise(every)


def candidates(model: Column, stable: Column, dead: Column) -> Column:
    """Models to try in order: the one asked for, then the stable ones, without those known to be gone unless all are."""
    order = F.array_distinct(F.concat(F.array(model), stable))
    live = F.filter(order, lambda m: ~F.array_contains(dead, m))
    return F.when(F.size(live) > 0, live).otherwise(order)
