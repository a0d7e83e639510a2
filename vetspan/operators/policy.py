"""Decisions on messages: evidence, thresholds, modes, and the chain in which the first terminal rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import let


def trust_met(requirement: str, dkim: Column, spf: Column) -> Column:
    return {"dkim": dkim, "spf": spf, "either": dkim | spf, "both": dkim & spf}[requirement]


def ai_action(verdict: Column, score: Column, reject_score: float) -> Column:
    """reject for an unwanted verdict from the threshold on, else accept."""
    return F.when((verdict == "unwanted") & (score >= reject_score), "reject").otherwise("accept")


def in_mode(action: Column, mode: str) -> Column:
    """In accept mode every action becomes accept."""
    return F.lit("accept") if mode == "accept" else action


def failure_action(failed: Column, action: str) -> Column:
    return F.when(failed, action)


def attachment_action(error: Column, detection: Column, malformed: str, encrypted: str, unscannable: str) -> Column:
    """A finding always means reject; scan errors have an action by kind; null where there is neither."""
    return F.when(detection.isNotNull(), "reject").when(error == "malformed", malformed).when(error == "encrypted", encrypted).when(error.isNotNull(), unscannable)


def incomplete(mime: Column, transfer: Column, extraction: Column) -> Column:
    return F.coalesce(mime, F.lit(False)) | F.coalesce(transfer, F.lit(False)) | F.coalesce(extraction, F.lit(False))


def first_terminal(rules: list[tuple[str, Column]], default: str = "accept") -> Column:
    """struct<rule, action> of the first rule whose action isn't null; rule "none" with the default."""
    out = F.struct(F.lit("none").alias("rule"), F.lit(default).alias("action"))
    for name, action in reversed(rules):
        out = F.when(action.isNotNull(), F.struct(F.lit(name).alias("rule"), action.alias("action"))).otherwise(out)
    return out


def knows_sender(matched: Column, all_matched: Column, complete: Column, match_all: bool) -> Column:
    """Known correspondent: any recipient knows the sender, or with match_all every one of a complete set."""
    return complete & all_matched if match_all else matched > 0


def bypass(known: Column, complete: Column, trusted: Column, from_headers: Column) -> Column:
    """Known senders with complete recipients and met trust skip analysis; several From headers rule it out."""
    return known & complete & trusted & (from_headers == 1)


def result_headers(scanned: Column, incomplete: Column, failed: Column, selected: Column, proposed: Column, verdict: Column, score: Column, low_below: float = 0.8) -> Column:
    """struct<classification, score, confidence, action, policy> of an accepted message: null fields aren't written.

    scanned is false for a message that bypassed analysis. proposed is what analysis asked for, selected
    what was done. A score is written in the fewest digits.
    """
    digits = F.regexp_replace(score.cast("string"), r"\.0$", "")
    asked = F.when(proposed == "reject", "accepted-accept-mode").when(verdict == "unwanted", "accepted-below-threshold").otherwise("accepted")

    def row(classification, action, scored=None, policy=None) -> Column:
        text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
        confidence = F.lit("unavailable") if scored is None else F.when(score < low_below, "low").otherwise("high")
        return F.struct(text(classification).alias("classification"), text(scored).alias("score"), confidence.alias("confidence"), text(action).alias("action"), text(policy).alias("policy"))

    return (
        F.when(~scanned, row("not-scanned", "accepted-bypass"))
        .when(incomplete, row("not-scanned", "accepted-accept-mode", policy="incomplete-inspection"))
        .when(failed & (selected == "accept"), row("unavailable", "accepted-ai-error"))
        .when(verdict.isNull() | (verdict == ""), row("unavailable", asked))
        .otherwise(row(verdict, asked, digits))
    )


def post_decision_updates(incomplete: Column, selected: Column, authenticated: Column, failed: Column, resource_reject: Column, verdict: Column, visible_sender: Column) -> Column:
    """Which stores a decision writes to: struct<rejection, rejection_policy, ip_strike, legitimate_ip, learnt_recipients, classification>.

    An incomplete inspection only records its rejection; a rejection for resources is no strike, and a
    failed analysis is evidence for nobody.
    """
    rejected, whole = selected == "reject", ~incomplete
    fields = {
        "rejection": rejected,
        "rejection_policy": F.when(rejected, F.when(incomplete, "incomplete-inspection").otherwise("ai")),
        "ip_strike": whole & rejected & ~authenticated & ~resource_reject,
        "legitimate_ip": whole & ~authenticated & ~failed & F.coalesce(verdict == "legitimate", F.lit(False)),
        "learnt_recipients": whole & (selected == "accept") & authenticated,
        "classification": whole & ~authenticated & ~failed & ~resource_reject & F.coalesce(visible_sender != "", F.lit(False)),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


#: Concealment reasons by bit; the lowest set bit is the one that is told.
REASONS = ("display:none", "visibility:hidden", "visibility:collapse", "opacity", "font-size", "color-match", "empty-clip", "content-visibility:hidden")


def primary_reason(bits: Column, opacity: Column, font_size: Column) -> Column:
    """struct<reason, value>: opacity and font-size come with their values, others with an empty one; without bits the first."""
    out = F.struct(F.lit(REASONS[0]).alias("reason"), F.lit("").alias("value"))
    for i in reversed(range(len(REASONS))):
        value = {"opacity": F.regexp_replace(F.round(opacity, 6).cast("string"), r"\.0$", ""), "font-size": font_size}.get(REASONS[i], F.lit(""))
        out = F.when(bits.bitwiseAND(1 << i) != 0, F.struct(F.lit(REASONS[i]).alias("reason"), value.alias("value"))).otherwise(out)
    return out


def merged_label(cases: Column) -> Column:
    """Label over viewing cases visible, concealed, unknown: any unknown is unknown, both kinds are client-dependent."""
    has = lambda x: F.array_contains(cases, x)
    return F.when(has("unknown"), "unknown").when(has("visible") & has("concealed"), "client-dependent").when(has("concealed"), "concealed").otherwise("visible")


def visibility(display_none: Column, alpha: Column, font_px: Column, colour_distance: Column, unknown: Column) -> Column:
    """concealed, unknown or visible from computed values; nulls are unknown values that conceal nothing by themselves."""
    reasons = F.coalesce(display_none, F.lit(False)) | F.coalesce(alpha <= 0.01, F.lit(False)) | F.coalesce(font_px <= 2, F.lit(False)) | F.coalesce(colour_distance <= 0.005, F.lit(False))
    return F.when(reasons, "concealed").when(unknown, "unknown").otherwise("visible")


#: What `decided_visibility` reads of a style: null is a value that isn't known, missing fields are of a plain element.
STYLE = {"display_none": False, "visibility": "visible", "alpha": 1.0, "clipped": False, "content_hidden": False, "word_hidden": False, "has_text": True, "font_px": 16.0, "font_uncertain": False, "colour_distance": 1.0,
         "layout_uncertain": False, "animated": False, "surely_none": False, "uncertain_reasons": 0}


def decided_visibility(style: dict[str, Column]) -> Column:
    """struct<label, reasons> of an element's computed values (STYLE): reasons is the bits of REASONS that hold.

    Concealed needs a reason that no reader ignores (uncertain_reasons are bits that some ignore or a colour scheme
    can lift), else the label is unknown, as it is for animated elements, for values that aren't known and for text
    that one kind of reader hides (word_hidden). Size and colour count only for elements with text; a font whose size
    is uncertain conceals only at 0. surely_none conceals in any case.
    """
    s = F.struct(*[style.get(n, F.lit(v)).alias(n) for n, v in STYLE.items()])

    def of(x: Column) -> Column:
        holds = lambda c: F.coalesce(c, F.lit(False))
        text, size = holds(x["has_text"]), x["font_px"]
        tests = (
            x["display_none"], x["visibility"] == "hidden", x["visibility"] == "collapse", x["alpha"] <= 0.01 + 1e-14,
            text & (size <= 2) & (~F.coalesce(x["font_uncertain"], F.lit(True)) | (size == 0)), text & (x["colour_distance"] <= 0.005), x["clipped"], x["content_hidden"],
        )
        bits = sum((F.when(holds(t), 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
        known = lambda *names: ~F.exists(F.array(*[x[n].isNull() for n in names]), lambda missing: missing)
        whole = known("display_none", "visibility", "alpha", "clipped", "content_hidden", "word_hidden") & ~F.coalesce(x["layout_uncertain"], F.lit(True)) & (~text | (known("font_px", "colour_distance") & ~F.coalesce(x["font_uncertain"], F.lit(True))))

        def named(b: Column) -> Column:
            firm = b.bitwiseAND(F.bitwise_not(F.coalesce(x["uncertain_reasons"], F.lit(0)))) != 0
            seen = F.when(whole & ~holds(x["word_hidden"]), "visible").otherwise("unknown")
            label = F.when(holds(x["surely_none"]), "concealed").when(holds(x["animated"]), "unknown").when(b != 0, F.when(firm, "concealed").otherwise("unknown")).otherwise(seen)
            return F.struct(label.alias("label"), b.alias("reasons"))

        return let(bits, named)

    return let(s, of)
