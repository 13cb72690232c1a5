"""Validation of whole documents and repair of their totals, in whole cents. A check is true, false or undecided (null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxwise.operators.checks import row_mode


def near(a: Column, b: Column, tolerance: int) -> Column:
    return F.abs(a - b) <= tolerance


def share_of(base: Column, per_cent: Column) -> Column:
    """So many per cent of an amount, rounded half away from zero."""
    raw = base * per_cent
    return (F.sign(raw) * F.floor((F.abs(raw) * 2 + 100) / 200)).cast("long")


def item_checks(q: Column, p: Column, a: Column, v: Column, g: Column, discount: Column, rate: Column, tolerance: int = 2) -> dict[str, Column]:
    """valid, rate_valid, and the effective amount and tax of a row: printed per unit, they count by the quantity."""
    mode = row_mode(q, p, a, v, g, discount, tolerance)
    unit = mode == "per_unit"
    rate_valid = near(share_of(a, rate), v, tolerance)
    return {
        "mode": mode,
        "rate_valid": rate_valid,
        "valid": mode.isin("direct", "per_unit") & F.coalesce(rate_valid, F.lit(True)),
        "effective": F.when(unit, q * a - F.coalesce(discount, F.lit(0))).otherwise(a),
        "effective_vat": F.when(unit, q * v).otherwise(v),
    }


def total_checks(t: dict[str, Column], tolerance: int = 2) -> dict[str, Column]:
    """Checks of a document's totals against its rows.

    t has subtotal, discount, taxable, rate, vat, other, net as printed (null where not), and of the rows n, n_amounts, amount_sum, n_taxes, tax_sum,
    n_valid, n_rates_valid."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    some, taxed = t["n"] > 0, (t["n"] > 0) & (t["n_taxes"] == t["n"])
    expected = t["subtotal"] - zero(t["discount"])
    base = F.coalesce(t["taxable"], expected)
    by_rows = t["rate"].isNull() & taxed & (t["n_rates_valid"] == t["n"])
    vat_expected = F.when(by_rows, t["tax_sum"]).otherwise(share_of(base, t["rate"]))
    net_expected = base + t["vat"] + zero(t["other"])
    true = lambda c: F.coalesce(c, F.lit(False))
    out = {
        "items_valid": some & (t["n_valid"] == t["n"]),
        "subtotal_valid": true(some & (t["n_amounts"] == t["n"]) & near(t["amount_sum"], t["subtotal"], tolerance)),
        "taxable_valid": near(t["taxable"], expected, tolerance),
        "vat_expected": vat_expected,
        "vat_valid": true(near(vat_expected, t["vat"], tolerance)),
        "net_expected": net_expected,
        "net_valid": true(near(net_expected, t["net"], tolerance)),
        "line_vat_matches": F.when(taxed, t["tax_sum"] == t["vat"]),
    }
    calculated = out["items_valid"] & out["subtotal_valid"] & out["vat_valid"] & out["net_valid"]
    out["checks_hold"] = calculated & F.coalesce(out["line_vat_matches"], F.lit(True)) & F.coalesce(out["taxable_valid"], F.lit(True))
    return out


def total_status(actual: Column, complete: Column, sums: list[Column], tolerance: int = 5) -> Column:
    """ok if a total is near one of the sums that its rows allow, the first first; undecided without the total, a whole first sum, or any later
    one to compare with."""
    fits = F.lit(False)
    for s in sums:
        fits = fits | F.coalesce(near(actual, s, tolerance), F.lit(False))
    whole = complete & actual.isNotNull()
    return F.when(~F.coalesce(whole, F.lit(False)), "unresolved").when(fits, "ok").when(sums[-1].isNull(), "unresolved").otherwise("mismatch")


def fill_totals(t: dict[str, Column], printed: Column, footer: Column, tolerance: int = 1) -> Column:
    """struct<subtotal, vat, net> of the gaps among three totals that a printed amount fills: it must be what the arithmetic asks for.

    t has subtotal, vat, net, discount, other, rate, and of the rows amount_sum and tax_sum (null if any row lacks its own). printed and footer
    are array<struct<k, amount>> in the order of preference; footer also has whole numbers but no item's cell."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    s, v, n, d, o = t["subtotal"], t["vat"], t["net"], zero(t["discount"]), zero(t["other"])

    def find(amounts: Column, target: Column, *used: Column) -> Column:
        free = lambda x: F.coalesce(near(x["amount"], target, tolerance), F.lit(False)) & ~F.exists(F.array(*used), lambda u: u.eqNullSafe(x["k"])) if used else F.coalesce(near(x["amount"], target, tolerance), F.lit(False))
        return F.get(F.filter(amounts, free), F.lit(0))

    none = F.lit(None).cast("long")
    whole = lambda a, b, c: F.struct(a.alias("subtotal"), b.alias("vat"), c.alias("net"))
    sub, tax = find(footer, t["amount_sum"]), None
    tax = find(footer, t["tax_sum"], sub["k"])
    net = find(footer, t["amount_sum"] + t["tax_sum"], sub["k"], tax["k"])
    unlabelled = F.when(sub.isNotNull() & tax.isNotNull() & net.isNotNull() & (t["tax_sum"] > 0), whole(sub["amount"], tax["amount"], net["amount"]))
    by_rows = find(printed, t["amount_sum"])
    net_by_rows = find(printed, t["amount_sum"] - d + v + o, by_rows["k"])
    # the printed rate pins the subtotal: the first amount whose tax is the printed one and whose net is printed too
    pairs = F.transform(printed, lambda x: F.struct(x.alias("sub"), find(printed, x["amount"] - d + v + o, x["k"]).alias("net")))
    fits = lambda y: (y["sub"]["amount"] != 0) & (F.abs((y["sub"]["amount"] - d) * t["rate"] - v * 100) <= 100 * tolerance) & y["net"].isNotNull()
    by_rate = F.get(F.filter(pairs, lambda y: F.coalesce(fits(y), F.lit(False))), F.lit(0))
    only_vat = F.when(by_rows.isNotNull() & net_by_rows.isNotNull(), whole(by_rows["amount"], none, net_by_rows["amount"])).when(by_rate.isNotNull() & (t["rate"] != 0), whole(by_rate["sub"]["amount"], none, by_rate["net"]["amount"]))
    return (
        F.when(s.isNull() & v.isNotNull() & n.isNotNull(), whole(find(printed, n - v - o + d)["amount"], none, none))
        .when(n.isNull() & s.isNotNull() & v.isNotNull(), whole(none, none, find(printed, s - d + v + o)["amount"]))
        .when(v.isNull() & s.isNotNull() & n.isNotNull(), whole(none, find(printed, n - s + d - o)["amount"], none))
        .when(s.isNull() & v.isNull() & n.isNull(), unlabelled)
        .when(v.isNotNull() & s.isNull() & n.isNull(), only_vat)
    )


def precedence(seen: Column, placed: Column, wins: Column, same: Column) -> tuple[Column, Column]:
    """value and note of a field read twice: the first reading stays, an empty one is filled, a placed one wins where its kind says so."""
    empty, differs = seen.isNull(), placed.isNotNull() & (seen != placed) & ~F.coalesce(same, F.lit(False))
    value = F.when(empty, placed).when(differs & wins, placed).otherwise(seen)
    note = F.when(empty & placed.isNotNull(), "filled").when(differs & wins, "replaced").when(differs, "disagree").otherwise("kept")
    return value, note


def attribution(same_spatial: Column, in_region: Column, has_region: Column, has_words: Column, other_row: Column, inconsistent: Column) -> Column:
    """Why a field is wrong: overruled, put into another row or column, misread, not read, or computed; the first cause that holds."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(same_spatial), "VISION_OVERRIDE")
        .when(yes(in_region) & yes(other_row), "PARSER_ROW")
        .when(yes(in_region), "PARSER_COLUMN")
        .when(yes(has_region) & yes(has_words), "OCR_CHAR_ERROR")
        .when(yes(has_region), "OCR_MISSING")
        .when(yes(other_row), "PARSER_ROW")
        .when(yes(inconsistent), "ARITHMETIC_INCONSISTENT")
        .otherwise("UNRESOLVED")
    )
