"""The shipped clinical rule set for respiratory events after an opioid, in its five versions.

Input: one row per visit with the count columns, ``naloxone_admin_prob``, the two joined
lists and a boolean ``has_confounder`` (made once with ``cohort.with_membership``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weaklabel.operators.rules import (
    ABSTAIN,
    CASE,
    CONTROL,
    Rule,
    RuleSet,
    all_zero,
    consecutive_text,
    evidence_sum,
    ladder,
    present,
    text_has,
    veto,
)

FINAL = 5
PROB = "naloxone_admin_prob"
FAILURE = "respiratory_failure_any"
VENT = "eligible_vent"

# Rules that are one count above zero, as (rule, column, vote, first round).
PRESENCE = [
    ("LF_counts_narcotic_overdose", "counts_narcotic_overdose", CASE, 2),
    ("LF_counts_hypoxia", "counts_hypoxia", CASE, 2),
    ("LF_counts_decrease_opioids", "counts_decrease_opioids", CASE, 2),
    ("LF_counts_no_pain_meds", "counts_no_pain_meds", CONTROL, 3),
    ("LF_counts_held_opioids", "counts_held_opioids", CASE, 4),
    ("LF_counts_pinpoint_pupils", "counts_pinpoint_pupils", CASE, 4),
]

# The order in which each version lists its rules.
ORDER = {
    1: [
        "LF_naloxone_admin",
        "LF_respiratory_failure_any",
        "LF_eligible_vent",
        "LF_counts_naloxone",
        "LF_counts_resp_care_notes",
        "LF_counts_rapid_response",
    ],
    2: [
        "LF_naloxone_admin",
        "LF_respiratory_failure_any",
        "LF_eligible_vent",
        "LF_counts_naloxone",
        "LF_counts_resp_care_notes",
        "LF_counts_no_acute_events",
        "LF_counts_altered_mental_status",
        "LF_counts_narcotic_overdose",
        "LF_counts_hypoxia",
        "LF_counts_decrease_opioids",
        "LF_confounding_diagnosis_for_rrt",
        "LF_extended_vent_time",
    ],
    3: [
        "LF_naloxone_admin",
        "LF_counts_naloxone",
        "LF_respiratory_failure_any",
        "LF_counts_resp_care_notes",
        "LF_counts_no_acute_events",
        "LF_counts_altered_mental_status",
        "LF_counts_narcotic_overdose",
        "LF_counts_hypoxia",
        "LF_counts_decrease_opioids",
        "LF_confounding_diagnosis_for_rrt",
        "LF_extended_vent_time",
        "LF_counts_no_pain_meds",
        "LF_no_support",
    ],
    4: [
        "LF_naloxone_admin",
        "LF_counts_naloxone",
        "LF_respiratory_failure_any",
        "LF_counts_resp_care_notes",
        "LF_counts_no_acute_events",
        "LF_counts_altered_mental_status",
        "LF_counts_narcotic_overdose",
        "LF_counts_hypoxia",
        "LF_counts_decrease_opioids",
        "LF_confounding_diagnosis_for_rrt",
        "LF_extended_vent_time",
        "LF_extended_respiratory_failure",
        "LF_counts_no_pain_meds",
        "LF_no_support",
        "LF_counts_held_opioids",
        "LF_counts_pinpoint_pupils",
    ],
}

# Rules each round dropped after looking at its own summary.
DROPPED = {
    1: ["LF_eligible_vent"],
    2: ["LF_eligible_vent", "LF_counts_altered_mental_status"],
    3: ["LF_counts_altered_mental_status", "LF_confounding_diagnosis_for_rrt"],
    4: ["LF_confounding_diagnosis_for_rrt", "LF_extended_respiratory_failure"],
}
ORDER[FINAL] = [name for name in ORDER[4] if name not in DROPPED[4]]

# Signals that must all be zero for "no support" / for lack of other evidence.
NO_EVIDENCE = [
    "counts_naloxone",
    "counts_altered_mental_status",
    "counts_narcotic_overdose",
    "counts_hypoxia",
    "counts_decrease_opioids",
]
ACUTE = [
    "counts_naloxone",
    "counts_rapid_response",
    "counts_altered_mental_status",
    "counts_narcotic_overdose",
    "counts_hypoxia",
]


def _effect(version: int) -> Column:
    """What the notes say about the drug's effect; without a word on it, case."""
    worked, failed = F.col("counts_naloxone_effective"), F.col("counts_naloxone_NOT_effective")
    steps = [(worked > 0, CASE), (failed > 0, CONTROL)]
    if version >= 4:
        steps.insert(0, (failed > worked, CONTROL))
    return ladder(*steps, otherwise=CASE)


def _drug_given(version: int) -> Column:
    limit = 0.8 if version >= 4 else 0.75
    vote = F.lit(CASE) if version == 1 else _effect(version)
    missing = CONTROL if version >= 4 else ABSTAIN
    return F.when(F.col(PROB) >= limit, vote).when(F.col(PROB) < limit, CONTROL).otherwise(missing)


def _drug_mentioned(version: int) -> Column:
    vote = F.lit(CASE) if version <= 2 else _effect(version)
    return F.when(F.col("counts_naloxone") > 0, vote).otherwise(ABSTAIN)


def _failure(version: int) -> Column:
    failed = text_has(FAILURE, "1")
    if version == 1:
        return ladder((failed, CASE), otherwise=CONTROL)
    if version == 2:
        quiet = all_zero(*NO_EVIDENCE) & F.col(PROB).isNull()
        return F.when(failed, veto("has_confounder", CONTROL, ladder((quiet, CONTROL), otherwise=CASE))).otherwise(CONTROL)
    return ladder((failed & text_has(VENT, "yes"), CONTROL))


def _no_acute(version: int) -> Column:
    parts = [*ACUTE, "counts_held_opioids"] if version >= 4 else ACUTE
    quiet_note = F.col("counts_no_acute_events") > 0
    return F.when(quiet_note, ladder((evidence_sum(*parts) > 0, ABSTAIN), otherwise=CONTROL)).otherwise(ABSTAIN)


def _altered(version: int) -> Column:
    inner = F.lit(CASE)
    if version >= 3:
        inner = veto("has_confounder", ABSTAIN if version >= 4 else CONTROL, inner)
    return F.when(F.col("counts_altered_mental_status") > 0, inner).otherwise(ABSTAIN)


def _no_support(version: int) -> Column:
    signals = [*NO_EVIDENCE, "counts_rapid_response"]
    if version >= 4:
        signals += ["counts_held_opioids", "counts_pinpoint_pupils"]
    return ladder((all_zero(*signals) & F.col(PROB).isNull() & ~text_has(FAILURE, "1"), CONTROL))


def respiratory_rules(version: int = FINAL) -> RuleSet:
    """The rule set of rounds 1-4 as first applied, or (5) the final one."""
    votes = {
        "LF_naloxone_admin": _drug_given(version),
        "LF_counts_naloxone": _drug_mentioned(version),
        "LF_respiratory_failure_any": _failure(version),
        "LF_eligible_vent": ladder((text_has(VENT, "yes"), CASE)),
        "LF_counts_resp_care_notes": ladder((F.col("counts_resp_care_notes") == 0, CONTROL)),
        "LF_counts_rapid_response": present("counts_rapid_response", CASE, otherwise=CONTROL),
        "LF_counts_no_acute_events": _no_acute(version),
        "LF_counts_altered_mental_status": _altered(version),
        "LF_confounding_diagnosis_for_rrt": veto(
            "has_confounder", ABSTAIN if version >= 4 else CONTROL, present("counts_rapid_response", CASE)
        ),
        "LF_extended_vent_time": ladder((consecutive_text(VENT, "yes", 4), CONTROL)),
        "LF_extended_respiratory_failure": ladder((consecutive_text(FAILURE, "1", 4), CONTROL)),
        "LF_no_support": _no_support(version),
    }
    votes |= {name: present(column, vote) for name, column, vote, _first in PRESENCE}
    return RuleSet(Rule(name, votes[name]) for name in ORDER[version])


def respiratory_rules_after_review(version: int) -> RuleSet:
    """The rules a round kept."""
    return respiratory_rules(version).without(*DROPPED.get(version, []))
