"""A tiny invented support domain (an e-book reader) for tests and examples.

Real domains are passed in as parameters or dimension tables; nothing in the operators knows this one.
"""

from __future__ import annotations

from sparkcurate.operators.generate import CaseKit
from sparkcurate.operators.rules import RuleBook

ABSTAIN = "UNDECIDED"

BOOK = RuleBook(
    labels=("SYNC_STALLED", "LICENCE_LAPSED", "REGION_BLOCKED"),
    abstain=ABSTAIN,
    signatures={
        "SYNC_STALLED": [["airplane mode"], ["spinning wheel"], ["pages", "other device"]],
        "LICENCE_LAPSED": [["borrowed"], ["loan", "ended"], ["greyed out"]],
        "REGION_BLOCKED": [["abroad"], ["moved", "country"], ["not available here"]],
    },
    runbooks={
        "SYNC_STALLED": {
            "runbook_id": "RB-SYNC", "owner_team": "Sync Team", "support_contact": "sync desk",
            "escalation": "Sync on-call", "severity": "S3", "priority": "P3"},
        "LICENCE_LAPSED": {
            "runbook_id": "RB-LIC", "owner_team": "Licence Team", "support_contact": "licence desk",
            "escalation": "Licence on-call", "severity": "S2", "priority": "P2"},
        "REGION_BLOCKED": {
            "runbook_id": "RB-REG", "owner_team": "Catalogue Team",
            "support_contact": "catalogue desk", "escalation": "Rights on-call", "severity": "S3",
            "priority": "P2"},
    },
    sub_causes={
        "SYNC_STALLED": {"queue_full": "S2", "radio_off": "S4"},
        "LICENCE_LAPSED": {"clock_skew": "S3"},
    },
    out_of_catalogue=(("refund",), ("cracked",), ("battery",)),
)

KIT = CaseKit(
    book=BOOK,
    paraphrases=("{q}", "A reader wonders: {ql}", "Hello! {q}", "In one line, please: {ql}"),
    slices={"SYNC_STALLED": "sync", "LICENCE_LAPSED": "licence", "REGION_BLOCKED": "region",
            ABSTAIN: "abstention"},
    cues={
        "SYNC_STALLED": [
            ("My reader was in airplane mode all week.", "reader in airplane mode all week"),
            ("I only see a spinning wheel on the shelf.", "spinning wheel on the shelf"),
            ("The newest pages show on my other device.", "newest pages on other device"),
        ],
        "LICENCE_LAPSED": [
            ("The novel was borrowed from the city library.", "novel borrowed from city library"),
            ("The cover is greyed out on my shelf.", "cover greyed out on shelf"),
            ("Maybe the loan period has ended by now.", "loan period has ended"),
        ],
        "REGION_BLOCKED": [
            ("I am reading abroad this month.", "reading abroad this month"),
            ("We moved to a new country in spring.", "moved to new country in spring"),
            ("The store says the title is not available here.", "store says title not available here"),
        ],
    },
    openers={
        "SYNC_STALLED": "Since {time} {feature} does not update.",
        "LICENCE_LAPSED": "Since {time} I cannot open a title with {feature}.",
        "REGION_BLOCKED": "{feature} lost a purchase {time}.",
    },
    features=("the reading app", "my reader", "the family shelf"),
    times=("yesterday", "last week", "two days ago"),
    one_line={
        "SYNC_STALLED": "The device has not talked to the service.",
        "LICENCE_LAPSED": "The right to open the title has run out.",
        "REGION_BLOCKED": "The title is not licensed at the place of use.",
    },
    alternative={
        "SYNC_STALLED": ("LICENCE_LAPSED", "nothing hints at an expired loan"),
        "LICENCE_LAPSED": ("SYNC_STALLED", "the device is online"),
        "REGION_BLOCKED": ("LICENCE_LAPSED", "the purchase itself is permanent"),
    },
    unseen={
        "SYNC_STALLED": "the device's last contact",
        "LICENCE_LAPSED": "the end date of the loan",
        "REGION_BLOCKED": "the rights table of the title",
    },
    chain={
        "SYNC_STALLED": "the radio is off, changes queue up, and the shelf stays old",
        "LICENCE_LAPSED": "the loan ends, the key is withdrawn, and the title stays shut",
        "REGION_BLOCKED": "the place changes, the rights check fails, and the title hides",
    },
    to_confirm={
        "SYNC_STALLED": ("whether other devices are current",),
        "LICENCE_LAPSED": ("when the loan ends",),
        "REGION_BLOCKED": ("the account's home region",),
    },
    runbook_texts={
        "SYNC_STALLED": {
            "why_plain": "Your reader has not been able to fetch the newest state.",
            "why_technical": "The device queue has not drained.",
            "fix_steps": ("Bring the device online", "Drain the queue", "Compare shelves"),
            "eta_ttr": "Within an hour", "churn_level": "low", "churn_why": "short nuisance",
            "offer": "no credit", "proactive": False, "offer_note": "explain the cause",
            "customer_action": "Please switch the radio on for some minutes."},
        "LICENCE_LAPSED": {
            "why_plain": "The loan of this title is over.",
            "why_technical": "The licence key is past its end date.",
            "fix_steps": ("Check the end date", "Renew the loan", "Reload the key"),
            "eta_ttr": "Same day", "churn_level": "medium", "churn_why": "blocked in mid book",
            "offer": "one free renewal", "proactive": True, "offer_note": "once per loan",
            "customer_action": "Please renew the loan on your library page."},
        "REGION_BLOCKED": {
            "why_plain": "This title may not be shown where you are now.",
            "why_technical": "The rights check rejects the current region.",
            "fix_steps": ("Confirm the home region", "Correct the region", "Reload the shelf"),
            "eta_ttr": "One to two days", "churn_level": "medium", "churn_why": "paid title hidden",
            "offer": "one month credit", "proactive": True, "offer_note": "if paid recently",
            "customer_action": "Please check the home region in your account."},
    },
    ladders={
        "SYNC_STALLED": (
            ("Reload the shelf.", "LICENCE_LAPSED", "~1 min", "the title opens"),
            ("Switch the radio on and wait.", "SYNC_STALLED", "~5 min", "pages are current"),
            ("Write to us with the device name.", "escalate", "by support", "a person answers"),
        ),
        "LICENCE_LAPSED": (
            ("Reload the shelf.", "SYNC_STALLED", "~1 min", "the title opens"),
            ("Renew the loan.", "LICENCE_LAPSED", "~3 min", "a new end date shows"),
            ("Write to us with the title.", "escalate", "by support", "a person answers"),
        ),
        "REGION_BLOCKED": (
            ("Reload the shelf.", "SYNC_STALLED", "~1 min", "the title shows"),
            ("Check the home region.", "REGION_BLOCKED", "~2 min", "the region is right"),
            ("Write to us with the title.", "escalate", "by support", "a person answers"),
        ),
    },
    generic_ladder=(
        ("Reload the shelf.", "general", "~1 min", "the title shows"),
        ("Sign out and in again.", "general", "~2 min", "the title opens"),
        ("Note any message you see.", "general", "~1 min", "you can quote it"),
    ),
    vague=("It just does not work any more.", "Something is off with my books.",
           "Please fix this soon."),
    off_catalogue=("I want a refund for the reader.", "The glass cracked when it fell.",
                   "The battery dies within one hour."),
    route="person on duty",
    system_prompt="You sort tickets of an e-book service. Think first, then answer in JSON.",
    traces={
        "clean": "Reader says: {cues}. {line} Best fit {cause}; {other} is weaker, {why}. "
                 "Open point: {unseen}. I stay at {confidence}.",
        "selfcorrect": "First guess {other}. The words {cues} do not fit it, {why}. {line} So {cause}, "
                       "at {confidence}, with {unseen} still open.",
        "multihop": "Step by step: {chain}. The words {cues} match. {line} That makes it {cause} at "
                    "{confidence}; {unseen} would settle it.",
    },
    documents={
        "rca_md": "# {cause}\n{why_technical}\nSeen in the ticket: {evidence}\nBook: {runbook_id}, held by "
                  "{owner_team} ({severity}/{priority})",
        "work_order_md": "# Task for {owner_team}\n{steps}\nDesk {support_contact}, then {escalation}. Due: {eta_ttr}",
        "customer_email": "Dear reader, {why_plain} {customer_action} {credit}Happy reading!",
        "diagram_mermaid": "graph TD\n  shelf --> {cause}\n  {cause} --> desk",
    },
    faults={
        "cue_dropped": {
            "takes_other": True, "evidence": ("a shelf with no lamp on",),
            "only_cause": ("high", "most shelves have it"),
            "think": "Shelves mostly suffer from {cause}. I skip the reader's words."},
        "fabricated_telemetry": {"think": "Our sync webhook fired an hour ago, which leaves {cause}."},
        "overconfident": {
            "only_cause": ("sure", "no other book on the table"), "think": "{cause}. No doubt at 0.97."},
        "missing_fields": {"without": ("churn_risk", "compensation")},
        "forced_guess": {
            "takes_other": True, "evidence": (), "only_cause": ("high", "picked from the list"),
            "think": "No cue at all; I name {cause} anyway."},
        "overpromise": {
            "offer": ("every title free for life", "said in the mail"),
            "mail": "Dear reader, all your titles are free for life from today."},
        "single_path": {"one_step": "ask the desk", "think": "{think} One step will do."},
    },
    no_evidence="nothing quoted",
    credit_note="A month on the house is booked.",
    escalate_notes={"SYNC_STALLED": {"radio_off": "ask us for a radio check of the device."}},
)
