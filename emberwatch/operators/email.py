"""E-mail analytics (EML-01 … EML-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import let
from ..functions.severity import as_col, lookup

# Domain endings, file endings and link shorteners that raise suspicion.
SUSPICIOUS_TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".work", ".click", ".link")
SUSPICIOUS_EXTENSIONS = (
    ".exe", ".scr", ".js", ".vbs", ".bat", ".cmd", ".ps1", ".msi", ".jar", ".hta", ".wsf", ".lnk", ".pif", ".reg", ".com",
)
ARCHIVE_EXTENSIONS = (".zip", ".rar", ".7z", ".tar", ".gz")
SHORTENERS = ("bit.ly", "t.co", "goo.gl", "tinyurl.com", "ow.ly", "is.gd")

# Wording patterns per family, first one wins.
URGENCY_PATTERNS = (
    r"(?i)\b(urgent|immediate|action\s+required|act\s+now|limited\s+time)\b",
    r"(?i)\b(within\s+\d+\s+hours?|expires?\s+today|deadline)\b",
    r"(?i)\b(account\s+(suspended|locked|compromised|disabled))\b",
    r"(?i)\b(verify\s+(your\s+)?(account|identity|email))\b",
)
CREDENTIAL_PATTERNS = (
    r"(?i)\b(password|login|credential|sign\s*in)\b.*\b(update|verify|confirm|reset)\b",
    r"(?i)\b(update|verify|confirm)\b.*\b(password|login|credential)\b",
    r"(?i)\bclick\s+(here|below|link)\s+to\s+(verify|confirm|login|sign\s*in)\b",
    r"(?i)\benter\s+(your\s+)?(password|credentials)\b",
)
FINANCIAL_PATTERNS = (
    r"(?i)\b(invoice|payment|wire\s+transfer|bank\s+account)\b",
    r"(?i)\b(tax\s+refund|lottery|prize|winner|inheritance)\b",
    r"(?i)\b(bitcoin|crypto|investment\s+opportunity)\b",
    r"(?i)\b(\$\d+[,\d]*|\d+\s*dollars?)\b",
)
URL_PATTERN = r"""(?i)https?://[^\s<>"']+|www\.[^\s<>"']+"""

# Texts of a finding per class.
CLASS_SEVERITY = {
    "benign": "informational", "suspicious": "low", "possible_phishing": "medium",
    "possible_social_engineering": "medium", "malicious_indicators": "high",
}
CLASS_TEXT = {
    "suspicious": "This email contains minor suspicious indicators that warrant attention.",
    "possible_phishing": "This email exhibits characteristics consistent with phishing attempts.",
    "possible_social_engineering": "This email contains social engineering tactics to manipulate the recipient.",
    "malicious_indicators": "This email contains strong indicators of malicious intent.",
}
CLASS_ADVICE = {
    "malicious_indicators": (
        "Report this email to your security team immediately.", "Delete this email from your inbox.",
        "Do not download or open any attachments.",
    ),
    "possible_phishing": (
        "Verify the sender through an alternative channel.", "Do not enter any credentials on linked pages.",
        "Forward to your security team for review.",
    ),
    "possible_social_engineering": (
        "Be skeptical of urgent requests.", "Verify any financial requests through official channels.",
    ),
    "suspicious": ("Exercise caution before taking any action.",),
}
FIRST_ADVICE = "Do not click any links in this email."
BENIGN_TEXT = "No significant security indicators detected in this email."


def split_message(mails: DataFrame, column: str = "eml") -> DataFrame:
    """Message text → headers, body, subject, from, to.

    The first blank line ends the headers; a repeated header keeps its last value; folded lines are not joined.
    """
    lines = F.split(column, "\n")

    def cut(ls: Column) -> Column:
        blanks = F.filter(F.transform(ls, lambda l, i: F.when(F.trim(l) == "", i)), lambda i: i.isNotNull())
        at = F.coalesce(F.get(blanks, F.lit(0)), F.size(ls))
        return F.struct(F.slice(ls, F.lit(1), at).alias("head"), F.slice(ls, at + 2, F.greatest(F.size(ls) - at - 1, F.lit(0))).alias("rest"))

    def entries(head: Column) -> Column:
        kept = F.filter(head, lambda l: l.contains(":"))
        pairs = F.transform(kept, lambda l: F.struct(
            F.lower(F.trim(F.split_part(l, F.lit(":"), F.lit(1)))).alias("k"),
            F.trim(F.substring(l, F.instr(l, ":") + 1, F.length(l))).alias("v")))
        # keep the last value of a name
        return F.map_from_entries(let(pairs, lambda ps: F.filter(
            ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))))

    opened = mails.withColumn("_parts", let(lines, cut)).withColumn("headers", entries(F.col("_parts.head")))
    head = lambda name: F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))
    return opened.withColumns({
        "body": F.array_join("_parts.rest", "\n"), "subject": head("subject"), "from": head("from"),
        "to": F.when(F.map_contains_key("headers", "to"), F.transform(F.split(head("to"), ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>")),
    }).drop("_parts")


def address(c: Column | str) -> Column:
    """Bare address of a From-style text, the display name dropped."""
    text = F.coalesce(as_col(c), F.lit(""))
    bracketed = F.regexp_extract(text, r"<([^>]*)>", 1)
    return F.trim(F.when(text.contains("<"), bracketed).otherwise(text))


def address_domain(c: Column | str) -> Column:
    addr = address(c)
    return F.when(addr.contains("@"), F.split_part(addr, F.lit("@"), F.lit(2)))


def extract_urls(text: Column | str) -> Column:
    """Distinct links in order of appearance, each with its features."""
    links = F.array_distinct(F.regexp_extract_all(as_col(text), F.lit(URL_PATTERN), F.lit(0)))

    def netloc(u: Column) -> Column:
        full = F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("http://"), u))
        return F.lower(F.regexp_extract(full, r"^[^:/?#]+://([^/?#]*)", 1))

    def features(u: Column, domain: Column) -> Column:
        ends = F.lit(False)
        for tld in SUSPICIOUS_TLDS:
            ends = ends | domain.endswith(tld)
        short = F.lit(False)
        for host in SHORTENERS:
            short = short | domain.contains(host)
        dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
        return F.struct(
            u.alias("url"), domain.alias("domain"), domain.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}").alias("is_ip_based"),
            ends.alias("has_suspicious_tld"), F.greatest(dots - 1, F.lit(0)).alias("subdomain_count"), short.alias("is_shortened"),
        )

    pairs = F.transform(links, lambda u: F.struct(u.alias("u"), netloc(u).alias("d")))
    return F.transform(pairs, lambda p: features(p["u"], p["d"]))


def classify_attachments(attachments: Column | str) -> Column:
    def one(a: Column) -> Column:
        name = F.coalesce(a["filename"], F.lit(""))
        ext = F.when(name.contains("."), F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))).otherwise("")
        return F.struct(
            name.alias("filename"), ext.alias("extension"), F.coalesce(a["size"], F.lit(0)).alias("size_bytes"), a["content_type"].alias("content_type"),
            ext.isin(*SUSPICIOUS_EXTENSIONS).alias("is_suspicious_type"), ext.isin(*ARCHIVE_EXTENSIONS).alias("is_archive"),
        )

    return F.transform(as_col(attachments), one)


def auth_verdict(headers: Column | str, name: str) -> Column:
    value = F.lower(F.coalesce(F.try_element_at(as_col(headers), F.lit(name)), F.lit("")))
    return F.when(value.contains("pass"), "pass").when(value.contains("fail"), "fail").when(value.contains("none"), "none")


def first_pattern(text: Column | str, patterns) -> Column:
    """Text matched by the first pattern that hits; null when none does."""
    text = as_col(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for p in patterns:
        out = out.when(text.rlike(p), F.regexp_extract(text, p, 0))
    return out


def analyse(mails: DataFrame) -> DataFrame:
    """Sender, links, attachments and verdicts of each message."""
    cols = mails.columns
    for name, kind in (("headers", "map<string,string>"), ("body_html", "string"), ("attachments", "array<struct<filename:string,size:bigint,content_type:string>>"), ("subject", "string"), ("from", "string")):
        if name not in cols:
            mails = mails.withColumn(name, F.lit(None).cast(kind))
    head = lambda n: F.try_element_at("headers", F.lit(n))
    sender = F.coalesce(F.nullif(F.col("from"), F.lit("")), head("from"))
    return mails.withColumns({
        "sender": address(sender), "sender_domain": F.coalesce(address_domain(sender), F.lit("")), "reply_to_domain": address_domain(head("reply-to")),
        "urls": extract_urls(F.concat(F.coalesce("body", F.lit("")), F.coalesce("body_html", F.lit("")))),
        "files": F.coalesce(classify_attachments("attachments"), classify_attachments(F.array().cast("array<struct<filename:string,size:bigint,content_type:string>>"))),
        "spf_result": auth_verdict("headers", "received-spf"), "dkim_result": auth_verdict("headers", "dkim-signature"),
        "dmarc_result": auth_verdict("headers", "authentication-results"),
        "combined_text": F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))),
    })


def _ind(kind: str, text: Column | str, severity: str, confidence: str, evidence: Column, contribution: float) -> Column:
    return F.struct(
        F.lit(kind).alias("indicator_type"), (F.lit(text) if isinstance(text, str) else text).alias("description"), F.lit(severity).alias("severity"),
        F.lit(confidence).alias("confidence"), evidence.alias("evidence"), F.lit(contribution).alias("risk_contribution"),
    )


def indicators() -> Column:
    """All indicators of an analysed message, in check order."""
    single = lambda test, ind: F.filter(F.array(F.when(test, ind)), lambda x: x.isNotNull())
    per_url = F.flatten(F.transform("urls", lambda u: F.filter(F.array(
        F.when(u["is_ip_based"], _ind("ip_based_url", "URL uses IP address instead of domain", "medium", "high", u["url"], 0.15)),
        F.when(u["has_suspicious_tld"], _ind("suspicious_tld", "URL uses suspicious top-level domain", "low", "medium", u["domain"], 0.1)),
        F.when(u["subdomain_count"] > 3, _ind("excessive_subdomains", "URL has excessive subdomains", "low", "medium", u["domain"], 0.1)),
    ), lambda x: x.isNotNull())))
    per_file = F.transform(F.filter("files", lambda a: a["is_suspicious_type"]), lambda a: _ind(
        "suspicious_attachment", F.concat(F.lit("Suspicious attachment type: "), a["extension"]), "high", "high", a["filename"], 0.3))
    family = lambda patterns, kind, text, sev, c: single(
        F.col(f"_{kind}").isNotNull(), _ind(kind, text, sev, "medium", F.col(f"_{kind}"), c))
    mismatch = (F.coalesce("reply_to_domain", F.lit("")) != "") & (F.col("sender_domain") != "") & (F.col("reply_to_domain") != F.col("sender_domain"))
    return F.concat(
        single(mismatch, _ind("sender_mismatch", "Reply-To domain differs from sender domain", "medium", "high",
                              F.concat(F.lit("From: "), F.col("sender_domain"), F.lit(", Reply-To: "), F.col("reply_to_domain")), 0.25)),
        single(F.col("spf_result") == "fail", _ind("spf_fail", "SPF authentication failed", "medium", "high", F.lit("SPF: fail"), 0.2)),
        single(F.col("dkim_result") == "fail", _ind("dkim_fail", "DKIM signature verification failed", "medium", "high", F.lit("DKIM: fail"), 0.2)),
        per_url, per_file,
        family(URGENCY_PATTERNS, "urgency_language", "Email contains urgency language", "low", 0.1),
        family(CREDENTIAL_PATTERNS, "credential_request", "Email requests credentials or login", "medium", 0.2),
        family(FINANCIAL_PATTERNS, "financial_indicator", "Email contains financial/scam indicators", "low", 0.1),
    )


def _count(kinds: tuple) -> Column:
    return F.size(F.filter("indicators", lambda x: x["indicator_type"].isin(*kinds)))


def classification() -> Column:
    risk = F.col("risk_score")
    high = F.exists("indicators", lambda x: x["severity"] == "high")
    return (
        F.when(F.size("indicators") == 0, "benign").when(high | (risk >= 0.7), "malicious_indicators")
        .when((_count(("credential_request", "sender_mismatch", "ip_based_url")) >= 2) | (risk >= 0.5), "possible_phishing")
        .when((_count(("urgency_language", "financial_indicator")) >= 2) | (risk >= 0.3), "possible_social_engineering")
        .when(risk >= 0.1, "suspicious").otherwise("benign")
    )


def email_findings(mails: DataFrame) -> DataFrame:
    """Indicators, risk, class, explanation and advice per message; no shuffle."""
    done = analyse(mails)
    done = done.withColumns({
        "_urgency_language": first_pattern("combined_text", URGENCY_PATTERNS), "_credential_request": first_pattern("combined_text", CREDENTIAL_PATTERNS),
        "_financial_indicator": first_pattern("combined_text", FINANCIAL_PATTERNS),
    }).withColumn("indicators", indicators()).drop("_urgency_language", "_credential_request", "_financial_indicator")
    total = F.aggregate("indicators", F.lit(0.0), lambda a, x: a + x["risk_contribution"])
    done = done.withColumn("risk_score", F.least(F.round(total, 10), F.lit(1.0))).withColumn("classification", classification())
    benign = F.col("classification") == "benign"
    kinds = F.array_join(F.transform("indicators", lambda x: F.replace(x["indicator_type"], F.lit("_"), F.lit(" "))), ", ")
    advice = F.when(benign, F.array().cast("array<string>"))
    for name, lines in CLASS_ADVICE.items():
        advice = advice.when(F.col("classification") == name, F.array(F.lit(FIRST_ADVICE), *[F.lit(x) for x in lines]))
    listed = lambda *xs: F.when(benign, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(x) for x in xs]))
    return done.withColumns({
        "finding_type": F.lit("email_security_analysis"), "severity": lookup("classification", CLASS_SEVERITY, "low"),
        "confidence": F.when(F.size("indicators") > 0, "high").otherwise("medium"),
        "explanation": F.when(benign, BENIGN_TEXT).otherwise(F.concat(lookup("classification", CLASS_TEXT), F.lit(" Detected indicators: "), kinds, F.lit("."))),
        "recommendations": advice, "mitre_techniques": listed("T1566", "T1566.001"), "mitre_tactics": listed("initial-access"),
    })
