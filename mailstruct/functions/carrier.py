"""Carrier classification as column expressions: security appliances, user submissions, scores, priorities and summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailstruct.functions.text import empty, let

# Vendors in order (subject pattern, header prefix), and the patterns of submissions.
VENDORS = {
    "proofpoint": (r"\bProofpoint\b", r"X-Proofpoint-"),
    "mimecast": (r"\bMimecast\b", r"X-MC-"),
    "o365quar": (r"\bquarantine\b", r"X-Microsoft-Antispam"),
    "ironport": (r"\b(IronPort|ESA)\b", r"X-IronPort-"),
    "barracuda": (r"\bBarracuda\b", r"X-Barracuda-"),
    "fortimail": (r"\bFortiMail\b", r"X-Fortimail-"),
    "trend_micro": (r"\bTrend\s*Micro\b", r"X-TMASE-"),
}
USER_MARKS = (r"^(FW|Fwd):", r"\b(phishing|suspicious)\b", r"\b(please\s+(check|review))\b")
SUBMISSIONS = {
    "user_forward": {
        "subject": (
            r"^(FW|Fwd|Forwarded?):\s*",
            r"\b(phishing|suspicious|malware|spam)\b",
            r"\b(analysis|review|investigate)\b",
            r"\b(please\s+(check|analyze|review))\b",
            r"\b(potential\s+(threat|phishing|scam))\b",
            r"\b(flagged|reported)\s+(as\s+)?(suspicious|phishing)\b",
        ),
        "body": (
            r"forwarded\s+message",
            r"please\s+(analyze|check|review|investigate)",
            r"suspicious\s+email",
            r"potential\s+(phishing|scam|malware)",
            r"received\s+this\s+(suspicious|odd|strange)",
            r"flagged\s+as\s+(suspicious|phishing)",
            r"asking\s+for\s+(credentials|password|login)",
            r"user\s+reported",
            r"employee\s+(received|forwarded)",
        ),
        "from": (),
    },
    "security_submission": {
        "subject": (
            r"\b(phishing|security|incident)\b.*\b(report|submission|alert)\b",
            r"\b(suspicious|malicious)\s+(email|message)\b",
            r"\b(security\s+team|IT\s+security)\b",
            r"^\[?(EXTERNAL|SPAM|PHISHING)\]?",
            r"\b(quarantine|held|blocked)\b",
            r"^(Phishing|Security|Alert):",
            r"\b(threat|malware)\s+(detected|found|analysis)\b",
        ),
        "body": (
            r"security\s+team\s+analysis",
            r"automated\s+(analysis|scan|review)",
            r"threat\s+(assessment|analysis)",
            r"email\s+security\s+(alert|notification)",
            r"submitted\s+for\s+(analysis|review)",
            r"please\s+investigate",
        ),
        "from": (r"security@", r"phishing@", r"noreply@", r"system@", r"admin@", r"it-security@", r"securityteam@"),
    },
}
FORWARDING = (r"^From:\s*.+@.+", r"^Sent:\s*.+", r"^To:\s*.+@.+", r"^Subject:\s*.+", r"-----Original Message-----", r"Begin forwarded message:", r"^Date:\s*.+", r"^Received:\s*.+", r"^Message-ID:\s*.+")
EMBEDDED = (r"Message-ID:\s*<.+@.+>", r"Received:\s*from\s+.+", r"X-\w+:\s*.+", r"Content-Type:\s*text/", r"MIME-Version:\s*1\.0", r"Return-Path:\s*.+@.+")
INTERNAL = (
    r"please\s+(review|analyze|check)",
    r"forwarding\s+for\s+(analysis|review)",
    r"flagged\s+by\s+(user|employee)",
    r"reported\s+by\s+.+@.+\..+",
    r"our\s+(user|employee|team)",
    r"internal\s+(review|analysis)",
    r"company\s+(policy|security)",
)
ORGANISATION = (r"\.com$", r"\.org$", r"\.edu$", r"\.gov$", r"\.co\.", r"\.inc$", r"\.corp$", r"\.llc$")
FORWARDING_VOTES, EMBEDDED_VOTES, SUBMISSION_SCORE = 3, 2, 3
#: Characters of a body that detection reads.
BODY_HEAD = 3000


#: What SQL engines on RE2 take the escapes and the letters with other cases than two for; Java's own \b knows more letters.
ASCII = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\s": r"[\t\n\f\r ]", **dict.fromkeys("kK", "[kK\u212a]"), **dict.fromkeys("sS", "[sS\u017f]")}


def matches(text: Column, pattern: str, flags: str = "isU", words: str = "unicode") -> Column:
    """Whether a pattern occurs. words: 'unicode', where every letter is part of a word, as for the parser, or 'ascii', as in SQL."""
    if words == "ascii":
        pattern, flags = re.sub(r"\\.|[kKsS]", lambda m: ASCII.get(m[0], m[0]) if "i" in flags or m[0][0] == "\\" else m[0], pattern), flags.replace("U", "")
    return empty(text).rlike(f"(?{flags}){pattern}")


def hits(text: Column, patterns: Sequence[str], flags: str = "isU", words: str = "unicode") -> Column:
    """How many of the patterns occur."""
    out = F.lit(0)
    for p in patterns:
        out = out + matches(text, p, flags, words).cast("int")
    return out


def found(text: Column, patterns: Sequence[str], flags: str = "isU") -> Column:
    """The patterns that occur, in order."""
    return F.array_compact(F.array(*(F.when(matches(text, p, flags), F.lit(p)) for p in patterns))) if patterns else F.array().cast("array<string>")


def vendor(subject: Column, headers: Column, mode: str = "intended", words: str = "unicode") -> Column:
    """The first appliance whose subject or header pattern matches. headers: name:value lines.

    Mode 'intended' matches header names at line starts; 'literal' reads the subject alone.
    """
    out = None
    for name, (by_subject, by_header) in VENDORS.items():
        hit = matches(subject, by_subject, words=words)
        if mode == "intended":
            hit = hit | matches(headers, f"^{by_header}", "imdU", words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def user_mark(subject: Column, words: str = "unicode") -> Column:
    """The first user-submission pattern that a subject matches."""
    return F.coalesce(*(F.when(matches(subject, p, words=words), F.lit(p)) for p in USER_MARKS))


def details(subject: Column, headers: Column, mode: str = "intended", words: str = "unicode") -> Column:
    """struct(is_carrier, vendor, type, confidence, detection_method, subject_match, confidence_score)."""

    def described(x: Column) -> Column:
        appliance, mark = x["appliance"], x["mark"]
        user = appliance.isNull() & mark.isNotNull()
        return F.struct(
            (appliance.isNotNull() | mark.isNotNull()).alias("is_carrier"),
            F.coalesce(appliance, F.when(user, F.lit("user_forward"))).alias("vendor"),
            F.when(appliance.isNotNull(), F.lit("security_appliance")).when(user, F.lit("unknown")).alias("type"),
            F.when(appliance.isNotNull(), F.lit(1.0)).when(user, F.lit(0.3)).alias("confidence"),
            F.when(appliance.isNotNull(), F.lit("pattern_match")).when(user, F.lit("user_submission_analysis")).alias("detection_method"),
            F.when(user, mark).alias("subject_match"),
            F.when(user, F.lit(3)).alias("confidence_score"),
        )

    # both texts are made once, and each pattern is looked for once, however often its outcome is used
    sought = lambda t: F.struct(vendor(t["subject"], t["headers"], mode, words).alias("appliance"), user_mark(t["subject"], words).alias("mark"))
    return let(let(F.struct(subject.alias("subject"), headers.alias("headers")), sought), described)


def details_of(tag: Column, kind: Column, score: Column, submission: Column) -> Column:
    """struct(vendor, type, confidence, detection_method) from a raw detection: no kind, an appliance, a submission, or other."""
    known = submission.isin("user_forward", "security_submission", "helpdesk_submission")
    return F.struct(
        tag.alias("vendor"),
        F.when(kind == "security_appliance", F.lit("security_appliance")).when((kind == "user_submission") & known, submission).otherwise(F.lit("unknown")).alias("type"),
        F.when(kind.isNull() | (kind == "security_appliance"), F.lit(1.0)).when(kind == "user_submission", empty_number(score) / F.lit(10.0)).otherwise(F.lit(0.5)).alias("confidence"),
        F.when(kind == "security_appliance", F.lit("pattern_match")).when(kind == "user_submission", F.lit("user_submission_analysis")).otherwise(F.lit("unknown")).alias("detection_method"),
    )


def empty_number(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def forwards(body: Column, words: str = "unicode") -> Column:
    return hits(body, FORWARDING, "imdU", words) >= FORWARDING_VOTES


def embeds_headers(body: Column, words: str = "unicode") -> Column:
    return hits(body, EMBEDDED, "idU", words) >= EMBEDDED_VOTES


def internal(sender: Column, body: Column, words: str = "unicode") -> Column:
    """Whether a body speaks of an internal report, or the domain after the last @ is an organisation's."""
    domain = F.lower(F.substring_index(empty(sender), "@", -1))
    return (hits(body, INTERNAL, "idU", words) > 0) | (empty(sender).contains("@") & (hits(domain, ORGANISATION, "") > 0))


def structure(has_eml: Column, has_message: Column, sender: Column, body: Column, attachments: Column, words: str = "unicode") -> Column:
    """struct(score, indicators) of the structural signs of a submission."""
    signs = [
        (has_eml, 3, F.lit("has_eml_attachments")),
        (has_message, 3, F.lit("has_message_attachments")),
        (forwards(body, words), 2, F.lit("has_forwarding_headers")),
        (embeds_headers(body, words), 2, F.lit("contains_email_headers_in_body")),
        (internal(sender, body, words), 1, F.lit("internal_domain_sender")),
        (attachments > 1, 1, F.concat(F.lit("multiple_attachments:"), attachments.cast("string"))),
    ]

    def weighed(there: Column) -> Column:
        score = F.lit(0)
        for i, (_, worth, _) in enumerate(signs):
            score = score + F.when(there[i], worth).otherwise(0)
        return F.struct(score.alias("score"), F.array_compact(F.array(*(F.when(there[i], name) for i, (_, _, name) in enumerate(signs)))).alias("indicators"))

    return let(F.array(*(sign for sign, _, _ in signs)), weighed)


def submission(subject: Column, sender: Column, body: Column, structural: Column, words: str = "unicode") -> Column:
    """struct(submission_type, confidence_score, is_carrier, vendor): the kind with the strictly largest score, the first on ties."""
    (first, p), (second, q) = SUBMISSIONS.items()
    votes = [hits(subject, x["subject"], words=words) * 2 + hits(body, x["body"], words=words) + hits(sender, x["from"], words=words) for x in (p, q)]

    def decided(x: Column) -> Column:
        a, b = x[0] + x[2], x[1] + x[2]
        kind = F.when((a > 0) & (a >= b), F.lit(first)).when(b > 0, F.lit(second))
        best = F.greatest(a, b, F.lit(0))
        return F.struct(kind.alias("submission_type"), best.alias("confidence_score"), (best >= SUBMISSION_SCORE).alias("is_carrier"), F.when(best >= SUBMISSION_SCORE, F.concat(F.lit("user_"), kind)).alias("vendor"))

    # each pattern is looked for once, however often its vote counts
    return let(F.array(*votes, structural), decided)


def priority(tag: Column) -> Column:
    """Without a carrier the content itself is the threat; known carriers only wrap it."""
    bare = F.coalesce(tag, F.lit("")) == ""
    return F.when(bare, "HIGH").when(tag.startswith("user_") | tag.isin(*VENDORS), "LOW").otherwise("MEDIUM")


def summary(tag: Column, kind: Column) -> Column:
    """A sentence about a detection; kind is null without details."""
    return (
        F.when(F.coalesce(tag, F.lit("")) == "", F.lit("Direct email content (not a carrier)"))
        .when(kind.isNull(), F.concat(F.lit("Carrier detected: "), tag))
        .when(kind == "security_appliance", F.concat(F.lit("Security appliance: "), tag))
        .when(kind == "user_submission", F.concat(F.lit("User submission: "), tag))
        .otherwise(F.concat(F.lit("Carrier: "), tag))
    )


def layer_summary(is_carrier: Column) -> Column:
    return F.when(is_carrier, F.lit("Carrier email detected")).otherwise(F.lit("Direct email content"))
