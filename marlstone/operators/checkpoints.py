"""Checkpoint reads of a short cycle as column rules: exposure zone, quote execution, continuity, overlay of caps, review, blockers, posture lint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import finite

SHORT = ("short", "sell", "reduce")
CAPS = ("L0", "L1", "L2", "L3")
#: Verdicts that a later constraint leaves as they are.
TERMINAL = ("no_trade", "inapplicable", "exit_at_open", "review_only")


def directional_return(direction: Column, entry: Column, current: Column) -> Column:
    """Return in percent in the direction of the thesis: a short that fell has gained. Missing where a price is missing or not positive."""
    raw = F.when(finite(entry) > 0, (finite(current) - entry) / entry * 100.0)
    return F.when(direction.isin(*SHORT), -raw).otherwise(raw)


def signed_bps(start: Column, end: Column, direction: Column) -> Column:
    """Move from start to end in basis points, signed by the direction."""
    raw = F.when(finite(start) > 0, (finite(end) / start - 1.0) * 10000)
    return F.round(F.when(direction == "short", -raw).otherwise(raw), 4)


def cap_no(cap: Column) -> Column:
    """Place of a cap among CAPS; what is none counts as the tightest."""
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CAPS]), cap), F.lit(0)) - 1, F.lit(0))


def cap_name(no: Column) -> Column:
    return F.concat(F.lit("L"), no.cast("string"))


def exposure_zone(x: DataFrame, live: float = 180.0, delayed: float = 1200.0) -> DataFrame:
    """x with zone, gamma_status, regime, risk_state from spot, put_wall, gamma_flip, call_wall, net_gex, vrp, gamma_age, option_session, expiry_scope.

    Walls that are missing or out of order are invalid; an old read is a delayed reference, an older one stale.
    """
    spot, put, flip, call = (finite(F.col(c)) for c in ("spot", "put_wall", "gamma_flip", "call_wall"))
    ordered = F.coalesce((put <= flip) & (flip <= call), F.lit(False))
    zone = F.when(~ordered | spot.isNull(), "unavailable").when(spot < put, "below_put_wall").when(spot < flip, "put_to_flip").when(spot <= call, "flip_to_call").otherwise("above_call_wall")
    age = finite(F.col("gamma_age"))
    status = (
        F.when(~ordered | spot.isNull(), "invalid").when((F.col("option_session") == "RTH") & F.col("expiry_scope").isin("0DTE", "near") & (age <= live), "confirmed_live")
        .when(age <= delayed, "delayed_reference").otherwise("stale_for_checkpoint")
    )
    net, vrp = finite(F.col("net_gex")), finite(F.col("vrp"))
    regime = F.when(net < 0, "negative").when(net > 0, "positive").otherwise("unknown")
    x = x.withColumns({"zone": zone, "gamma_status": status, "regime": regime})
    low = F.col("zone").isin("below_put_wall", "put_to_flip")
    risk = (
        F.when((F.col("regime") == "negative") & low, F.when(vrp < 0, "breakdown_amplification").otherwise("negative_gamma_below_flip"))
        .when((F.col("regime") == "positive") & (F.col("zone") == "flip_to_call") & (vrp >= 0), "pin_possible_not_directional").otherwise("neutral")
    )
    return x.withColumn("risk_state", risk)


def execution_quality(x: DataFrame, most_age: float = 5.0, most_spread: float = 0.10) -> DataFrame:
    """x with hurdle_bps, failures (codes), execution_status of an option quote: no_trade, limit_only or eligible.

    The hurdle is half the spread (all of it for a market order), slippage and fees; the expected edge has to be above it.
    """
    bid, ask = finite(F.col("bid")), finite(F.col("ask"))
    mid = F.when((bid > 0) & (ask >= bid), (bid + ask) / 2)
    spread = (ask - bid) / mid
    cost = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0))
    hurdle = F.round(F.coalesce(spread * 10000, F.lit(0.0)) * F.when(F.col("order_type") == "market", 1.0).otherwise(0.5) + cost("slippage_bps") + cost("fees_bps"), 4)
    size = F.when(F.col("side") == "buy", finite(F.col("ask_size"))).otherwise(finite(F.col("bid_size")))
    x = x.withColumns({"hurdle_bps": hurdle, "__spread": spread, "__size": size, "__mid": mid})
    yes = lambda c: F.coalesce(c, F.lit(True))  # noqa: E731 - unknown counts as failed
    edge = finite(F.col("expected_edge_bps"))
    failures = F.array_compact(F.array(
        F.when(yes(~F.col("order_type").isin("market", "limit_mid", "limit")), "unknown_order_type"), F.when(yes(~F.col("side").isin("buy", "sell")), "unknown_order_side"), F.when(F.col("__mid").isNull(), "invalid_or_missing_bbo"),
        F.when(yes(finite(F.col("quote_age")) > most_age), "stale_option_quote"), F.when(yes((finite(F.col("contracts")) <= 0) | (F.col("__size") < F.col("contracts"))), "insufficient_top_of_book_size"),
        F.when(yes(F.col("__spread") > most_spread), "spread_too_wide"), F.when(edge.isNull(), "cost_edge_unknown").when(edge <= F.col("hurdle_bps"), "cost_edge_negative_after_friction"),
    ))
    x = x.withColumn("failures", failures)
    patient = (F.col("order_type") == "market") | (F.coalesce(finite(F.col("volume")), F.lit(0)) == 0)
    return x.withColumn("execution_status", F.when(F.size("failures") > 0, "no_trade").when(patient, "limit_only").otherwise("eligible")).drop("__spread", "__size", "__mid")


def continuity(x: DataFrame, least_volume: float = 0.8, good: float = 0.70, bad: float = 0.40) -> DataFrame:
    """x with continuity_score, continuity_missing, continuity_status: the share of five checks after the open that hold; two missing ones are a gap."""
    last, high, low = (finite(F.col(c)) for c in ("last", "range_high", "range_low"))
    held = lambda ref: F.when(F.col("direction") == "short", last <= ref).otherwise(last >= ref).cast("double")
    place = F.when(high > low, (last - low) / (high - low))
    place = F.when(F.col("direction") == "short", 1.0 - place).otherwise(place)
    checks = F.array(
        held(finite(F.col("previous_close"))), held(finite(F.col("vwap"))), (place >= 0.5).cast("double"), (finite(F.col("relative_volume")) >= least_volume).cast("double"),
        F.when(F.col("breadth").isNotNull() & F.col("sector").isNotNull(), (F.col("breadth") & F.col("sector")).cast("double")),
    )
    x = x.withColumn("__there", F.array_compact(checks)).withColumn("continuity_missing", F.lit(5) - F.size("__there"))
    score = F.when(F.size("__there") > 0, F.round(F.aggregate("__there", F.lit(0.0), lambda a, v: a + v) / F.size("__there"), 4))
    x = x.withColumn("continuity_score", score).drop("__there")
    s = F.col("continuity_score")
    return x.withColumn("continuity_status", F.when((F.col("continuity_missing") >= 2) | s.isNull(), "data_gap").when(s >= good, "pass").when(s < bad, "fail").otherwise("mixed"))


def overlay(x: DataFrame) -> DataFrame:
    """x (after the three reads) with verdict, reason, base_cap, gamma_cap, option_cap, final_cap, multiplier: constraints on an upstream cap.

    Caps only tighten: the final cap is the least of the upstream one, the base verdict's and those of the constraints that apply.
    """
    up = cap_no(F.col("action_cap"))
    at_open = F.col("checkpoint") == "open_0940"
    rules = [
        (F.col("checkpoint") == "eod_review", "review_only", "eod_review_only", up, 1.0), (F.col("market_scope") != "US_only", "inapplicable", "non_us_scope", F.lit(0), 0.0),
        ((up == 0) | ~F.coalesce(F.col("thesis_valid"), F.lit(True)), "no_trade", "upstream_not_executable", F.lit(0), 0.0), (F.col("pre_open_status") == "weak", "exit_at_open", "pre_open_read_weak", F.lit(0), 0.0),
        (~at_open, "eligible", "checkpoint_eligible", up, 1.0), (F.col("continuity_status") == "pass", "recompile_intraday", "continuity_pass", up, 1.0), (F.col("continuity_status") == "fail", "exit_or_reduce_by_0940", "continuity_failed", F.lit(0), 0.0),
    ]
    pick = lambda i, last: reduce(lambda other, r: F.when(r[0], r[i]).otherwise(other), reversed(rules), last)
    x = x.withColumns({"verdict": pick(1, F.lit("data_gap")), "reason": pick(2, F.lit("continuity_mixed_or_incomplete")), "__base": pick(3, F.least(up, F.lit(1))), "multiplier": pick(4, F.lit(0.5))})
    risky = F.col("risk_state").isin("breakdown_amplification", "negative_gamma_below_flip") & (F.col("direction") == "long")
    live, old = F.col("gamma_status") == "confirmed_live", F.col("gamma_status").isin("invalid", "stale_for_checkpoint")
    gamma = F.when(risky, F.least(F.when(live, 0).otherwise(1), up)).when(old, F.least(F.lit(1), up))
    option = F.when(F.col("execution_status") == "no_trade", 0).when(F.col("execution_status") == "limit_only", F.least(F.lit(1), up))
    ended = F.col("verdict").isin(*TERMINAL)
    verdict = F.when(ended, F.col("verdict")).when(risky & live, "exit_or_reduce_by_0940").when((risky | old) & at_open, "data_gap").otherwise(F.col("verdict"))
    x = x.withColumns({"base_cap": cap_name(F.col("__base")), "gamma_cap": cap_name(gamma), "option_cap": cap_name(option), "final_cap": cap_name(F.least(up, F.col("__base"), gamma, option))})
    return x.withColumn("verdict", verdict).drop("__base")


def review(x: DataFrame) -> DataFrame:
    """x with the end-of-day measures in basis points, labels and review_status from entry, open, 0940, close and exit prices and costs."""
    d = F.col("direction")
    cost, guess = (F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in ("realized_cost_bps", "estimated_cost_bps"))
    net = lambda to: F.round(signed_bps(F.col("entry_price"), F.col(to), d) - cost, 4)
    x = x.withColumns({
        "close_to_open_net_bps": net("open_price"), "open_to_0940_bps": signed_bps(F.col("open_price"), F.col("price_0940"), d), "to_close_bps": signed_bps(F.col("price_0940"), F.col("close_price"), d),
        "exit_net_bps": net("exit_price"), "counterfactual_net_bps": net("price_0940"), "cost_error_bps": F.round(cost - guess, 4),
    })
    labels = F.array_compact(F.array(F.when(F.col("cost_error_bps") > 0, "execution_cost_underestimated"), F.when(F.col("exit_net_bps") < F.col("counterfactual_net_bps"), "late_exit_vs_0940")))
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("close_to_open_net_bps", "open_to_0940_bps", "to_close_bps", "exit_net_bps", "counterfactual_net_bps")])
    return x.withColumns({"labels": labels, "review_status": F.when(gap, "partial_data").otherwise("reviewed")})


def blocker(x: DataFrame) -> Column:
    """Why a compiled decision does not open a position; it explains a result and changes none. The first rule that fits."""
    risk_modules = F.array(*[F.lit(m) for m in ("account", "portfolio_risk_budget", "brokerage_portfolio_margin")])
    size = finite(F.col("multiplier"))
    opens = F.col("permission").isin("TEST", "BUILD", "ADD")
    return (
        F.when(~F.coalesce(F.col("contract_ok"), F.lit(False)), "contract_gap").when(F.col("epistemic_veto"), "data_gap").when(F.arrays_overlap("veto_modules", risk_modules), "portfolio_or_permission")
        .when(F.col("hard_veto"), "market_risk").when(opens & size.isNull(), "contract_gap").when(opens & (size > 0), "ready").when(F.col("unresolved"), "unresolved_conflict").otherwise("no_edge_or_non_open_intent")
    )


def posture_errors(expected: str, actual: str) -> Column:
    """Codes of an actual posture (struct of cap, veto, multiplier, guards) that breaks the expected one (struct of ceiling, veto, multiplier, guards); what is not expected is not checked."""
    e, a = (lambda f: F.col(f"{expected}.{f}")), (lambda f: F.col(f"{actual}.{f}"))
    missing = F.array_except(F.coalesce(e("guards"), F.array().cast("array<string>")), F.coalesce(a("guards"), F.array().cast("array<string>")))
    codes = F.array_compact(F.array(
        F.when(e("ceiling").isNotNull() & (cap_no(a("cap")) > cap_no(e("ceiling"))), "action_exceeds_ceiling"), F.when(e("veto") != a("veto"), "veto_differs"),
        F.when(F.coalesce(a("multiplier"), F.lit(1.0)) > e("multiplier") + 1e-9, "multiplier_too_high"),
    ))
    return F.concat(codes, F.transform(F.array_sort(missing), lambda g: F.concat(F.lit("missing_guard:"), g)))


def loosened(before: str, after: str) -> Column:
    """Codes of a posture that became looser: a higher cap, a veto that went, a higher multiplier, guards that were dropped."""
    b, a = (lambda f: F.col(f"{before}.{f}")), (lambda f: F.col(f"{after}.{f}"))
    dropped = F.array_except(F.coalesce(b("guards"), F.array().cast("array<string>")), F.coalesce(a("guards"), F.array().cast("array<string>")))
    codes = F.array_compact(F.array(
        F.when(cap_no(a("cap")) > cap_no(b("cap")), "action_loosened"), F.when(b("veto") & ~a("veto"), "veto_dropped"), F.when(F.coalesce(a("multiplier"), F.lit(0.0)) > F.coalesce(b("multiplier"), F.lit(0.0)) + 1e-9, "multiplier_raised"),
    ))
    return F.concat(codes, F.transform(F.array_sort(dropped), lambda g: F.concat(F.lit("guard_dropped:"), g)))


#: Regimes that override a target's action level.
OVERRIDES = ("deleveraging_watch", "active_deleveraging", "forced_liquidation")


def red_flags(targets: DataFrame, evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """target, flags, max_cap, multiplier: from the regime of each target (target, regime), its evidence (target, family) and its gaps (target, error_class).

    No family at all is unknown and caps at L0; a single one caps at L1, as an unknown one beside others does. Caps tighten only.
    """
    known = F.when(F.col("family") != "unknown", F.col("family"))
    e = evidence.groupBy("target").agg(F.count_distinct(known).alias("families"), F.max((F.col("family") == "unknown").cast("int")).alias("unknown"))
    g = gaps.groupBy("target").agg(F.max((F.col("error_class") == "empty_fundamentals").cast("int")).alias("empty"))
    x = targets.join(e, "target", "left").join(g, "target", "left").na.fill(0, ["families", "unknown", "empty"])
    flags = F.array_compact(F.array(
        F.when(F.col("regime").isin(*OVERRIDES), "risk_regime_override"), F.when(F.col("empty") > 0, "fundamental_gap"), F.when(F.col("unknown") > 0, "unknown_source_family"),
        F.when(F.col("families") == 0, "insufficient_source_families").when(F.col("families") == 1, "single_source_family"),
    ))
    cap = F.when(F.col("families") == 0, 0).when((F.col("families") == 1) | (F.col("unknown") > 0), 1).otherwise(3)
    return x.select("target", F.array_join(flags, ",").alias("flags"), cap_name(cap).alias("max_cap"), F.when(cap == 0, 0.0).when(cap == 1, 0.5).otherwise(1.0).alias("multiplier"))


def study_bundle(scope: DataFrame, parts: dict[str, DataFrame], attributions: DataFrame) -> DataFrame:
    """study, components, gaps, in_scope, out_of_scope: one row for each study of scope (study, symbol).

    parts: named component tables (study, gap; gap null where the component is whole). attributions: (study, symbol) named by any part;
    those outside of the study's own symbols are counted apart.
    """
    told = reduce(DataFrame.unionByName, [d.select("study", F.lit(n).alias("component"), "gap") for n, d in parts.items()])
    c = told.groupBy("study").agg(F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"), F.array_join(F.array_sort(F.collect_set("gap")), ",").alias("gaps"))
    inside = scope.select("study", "symbol").distinct().withColumn("__in", F.lit(1))
    a = attributions.select("study", "symbol").distinct().join(inside, ["study", "symbol"], "left").groupBy("study").agg(F.count("__in").alias("in_scope"), F.count_if(F.col("__in").isNull()).alias("out_of_scope"))
    return scope.select("study").distinct().join(c, "study", "left").join(a, "study", "left").na.fill(0, ["in_scope", "out_of_scope"]).na.fill("", ["components", "gaps"])
