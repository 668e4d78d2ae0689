"""Raw payload → parsed fields, six formats in one projection (PRS-01 … PRS-08).

The work is done in three narrow steps so that no expression is written out twice: read the
payload once, pick the raw text of every field, then normalise the picked texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.network import norm_ip, norm_port
from ..functions.severity import lookup, map_severity
from ..plans.fence import once

# Order in which formats are tried when none is given.
DETECTION_ORDER = ("suricata", "email", "syslog", "application", "authentication", "json")

# Parser name and version per format.
PARSERS = {
    "suricata": ("suricata_eve_json_parser", "1.0.0"),
    "syslog": ("syslog_security_parser", "1.0.0"),
    "application": ("application_log_parser", "1.0.0"),
    "authentication": ("authentication_log_parser", "1.0.0"),
    "email": ("email_security_parser", "1.0.0"),
    "json": ("generic_json_parser", "1.0.0"),
}

# Line formats (positional groups).
RFC3164 = (
    r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+"
    r"([\w\.\-]+)\s+([\w\.\-\/]+)(?:\[(\d+)\])?:\s*(.*)$"
)
RFC5424 = r"^<(\d{1,3})>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(\[.*?\]|-))?\s+(.*)$"
SSHD_FAILED = r"(?i)Failed\s+password\s+for\s+(?:invalid\s+user\s+)?(\S+)\s+from\s+(\S+)\s+port\s+(\d+)"
SSHD_ACCEPTED = r"(?i)Accepted\s+(?:password|publickey)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)"
SSHD_INVALID_USER = r"(?i)Invalid\s+user\s+(\S+)\s+from\s+(\S+)"
SUDO = (
    r"(?i)(\S+)\s*:\s*(?:TTY=\S+\s*;\s*)?(?:PWD=\S+\s*;\s*)?USER=(\S+)\s*;\s*COMMAND=(.*)"
)
SUDO_AUTH_FAIL = r"(?i)pam_unix\(sudo:auth\):\s*authentication failure;.*rhost=(\S*)\s+user=(\S+)"
UFW = (
    r"(?i)\[UFW\s+(BLOCK|AUDIT|ALLOW)\]\s+IN=(\S*)\s+OUT=(\S*).*?"
    r"SRC=(\S+)\s+DST=(\S+).*?PROTO=(\S+)(?:\s+SPT=(\d+)\s+DPT=(\d+))?"
)
PAM_AUTH_FAIL = (
    r"(?i)pam_unix\((\S+):auth\):\s*authentication failure;.*?(?:rhost=(\S+))?.*?(?:user=(\S+))?"
)
COMBINED_LOG = (
    r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+'
    r'(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
)
APP_LOG = (
    r"(?i)^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[,\.]\d+)?)\s+"
    r"(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\s+(?:\[([\w\.\-]+)\]\s+)?(.*)$"
)
URI_SQLI = (
    r"(?i)(\b(select|union|insert|update|delete|drop|alter|exec|declare)\b|"
    r"--|'|%27|%22|information_schema)"
)
URI_XSS = r"(?i)(<script|%3Cscript|javascript:|onerror=|onload=|alert\(|document\.cookie)"
TEXT_AUTH_FAILED = r"(?i)Failed password for (?:invalid user )?(\S+) from (\S+)"
TEXT_AUTH_OK = r"(?i)Accepted password for (\S+) from (\S+)"

# Producers that mark a JSON payload.
AUTH_SOURCES = ("windows_security", "auth_log", "active_directory", "okta", "azure_ad", "iam")
APP_SOURCES = ("nginx", "apache", "webapp", "api_gateway", "fastapi")
EMAIL_SOURCES = ("email_gateway", "proofpoint", "mimecast", "dmarc_report", "phishing_filter")

# Windows event ids → type, severity, action, status.
WINDOWS_EVENTS = {
    4624: ("user_logon_success", "low", "allowed", "success"),
    4625: ("user_logon_failed", "high", "denied", "failure"),
    4648: ("user_logon_explicit_creds", "medium", "allowed", "success"),
    4672: ("special_privileges_assigned", "medium", "assigned", "success"),
    4720: ("user_account_created", "medium", "created", "success"),
    4726: ("user_account_deleted", "medium", "deleted", "success"),
    4728: ("user_added_to_security_group", "medium", "added", "success"),
    4738: ("user_account_modified", "low", "modified", "success"),
    4740: ("user_account_locked_out", "high", "locked", "failure"),
}
LOGON_TYPES = {
    "2": "Interactive (Console)", "3": "Network (SMB/RPC)", "4": "Batch", "5": "Service",
    "7": "Unlock", "8": "NetworkCleartext", "9": "NewCredentials",
    "10": "RemoteInteractive (RDP)", "11": "CachedInteractive",
}

# Names under which generic JSON carries each field, first one wins.
JSON_ALIASES = {
    "timestamp": ("timestamp", "@timestamp", "time", "event_time", "created_at", "dateTime", "EventTime", "TimeCreated"),
    "source_ip": ("source_ip", "src_ip", "src", "source.ip", "client_ip", "srcAddress", "sourceIPAddress", "clientIp", "IpAddress"),
    "destination_ip": ("destination_ip", "dest_ip", "dst", "destination.ip", "server_ip", "destAddress", "destinationIPAddress", "target_ip"),
    "source_port": ("source_port", "src_port", "src_pt", "source.port", "srcPort", "sourcePort", "IpPort"),
    "destination_port": ("destination_port", "dest_port", "dst_port", "destination.port", "destPort", "destinationPort", "target_port"),
    "protocol": ("protocol", "proto", "network.protocol", "transport", "network_protocol"),
    "username": ("username", "user", "user_name", "user.name", "principal", "TargetUserName", "actor", "userIdentity.userName"),
    "hostname": ("hostname", "host", "host.name", "computer_name", "Computer", "node_name", "WorkstationName"),
    "domain": ("domain", "realm", "domain_name", "user.domain", "TargetDomainName"),
    "event_type": ("event_type", "type", "name", "event_name", "eventName", "action_type", "activity"),
    "severity": ("severity", "level", "priority", "threat_level", "risk_level", "Severity"),
    "action": ("action", "event_action", "disposition", "decision", "rule_action"),
    "status": ("status", "result", "outcome", "event_status", "response_status"),
    "url": ("url", "uri", "request_url", "http.url"),
    "hash": ("hash", "sha256", "md5", "file.hash.sha256", "file_hash", "checksum"),
}

def _v() -> Column:
    return F.col("_v")


def _t() -> Column:
    return F.col("_t")


# Payload access is written as SQL text: one call per field instead of one per operator.
def _key_sql(name: str, kind: str = "string") -> str:
    return f"try_variant_get(_v, \"$['{name}']\", '{kind}')"


def _at_sql(dotted: str, kind: str = "string") -> str:
    steps = "".join(f"['{p}']" for p in dotted.split("."))
    return f"try_variant_get(_v, \"${steps}\", '{kind}')"


def _filled_sql(value: str) -> str:
    return f"CASE WHEN {value} NOT IN ('', '[]', '{{}}') THEN {value} END"


def _key(name: str, kind: str = "string") -> Column:
    return F.expr(_key_sql(name, kind))


def _at(dotted: str, kind: str = "string") -> Column:
    return F.expr(_at_sql(dotted, kind))


def _filled_at(dotted: str) -> Column:
    return F.expr(_filled_sql(_at_sql(dotted)))


def _j(name: str) -> Column:
    """Value of a top-level key, blank counted as absent."""
    return F.expr(_filled_sql(_key_sql(name)))


def _any(*names: str) -> Column:
    return F.expr(f"coalesce({', '.join(_filled_sql(_key_sql(n)) for n in names)})")


def _alias(field: str, kind: str = "string", filled: bool = False) -> Column:
    """First non-null value among the names of a field: the whole key first, then the nested path."""
    tries = []
    for name in JSON_ALIASES[field]:
        tries.append(_key_sql(name, kind))
        if "." in name:
            tries.append(_at_sql(name, kind))
    value = f"coalesce({', '.join(tries)})"
    return X.not_blank(F.expr(value)) if filled else F.expr(value)


def _has(name: str) -> Column:
    return F.expr(f"coalesce({_key_sql(name, 'variant')} IS NOT NULL, false)")


def _int_if_number(value: Column) -> Column:
    """JSON number (given as variant) → int, else null: text never counts as a level number."""
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(number, F.try_variant_get(value, "$", "int"))


def _double_if_number(value: Column) -> Column:
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(number, F.try_variant_get(value, "$", "double"))


def _tags_mention(word: str) -> Column:
    return F.expr(f"coalesce(contains(lower({_key_sql('tags')}), '{word}'), false)")


def _is(name: str, *values: str) -> Column:
    listed = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"coalesce({_key_sql(name)} IN ({listed}), false)")


def accepts() -> dict[str, Column]:
    """Acceptance test of every built-in format over ``_v`` / ``_t`` / ``_object``."""
    obj = F.col("_object")
    has = _has
    has_json = _v().isNotNull()
    suricata = has_json & (
        (has("event_type") & (has("src_ip") | has("dest_ip") | has("flow_id") | has("alert")))
        | _is("source", "suricata") | _is("app", "suricata") | _tags_mention("suricata")
    )
    email = F.when(
        obj,
        _is("source_type", "email") | _is("source", *EMAIL_SOURCES) | has("spf_result") | has("dmarc_result")
        | (has("sender") & has("recipient")) | (has("from_address") & has("to_address")),
    ).otherwise(
        _t().contains("dmarc=") | _t().contains("spf=") | _t().contains("dkim=") | F.lower(_t()).contains("phishing")
    )
    syslog = F.when(
        obj,
        _is("source_type", "syslog") | _is("source", "syslog") | _tags_mention("syslog")
        | (has("message") & has("hostname")),
    ).otherwise(
        _t().startswith("<") | _t().contains("sshd[") | _t().contains("sudo:") | _t().contains("[UFW ")
        | _t().rlike(RFC3164)
    )
    application = F.when(
        obj,
        _is("source_type", "application") | _is("source", *APP_SOURCES)
        | (has("status_code") & has("uri")) | (has("http_method") & has("url")),
    ).otherwise(
        _t().contains("HTTP/1.") | _t().contains("HTTP/2.") | _t().rlike(APP_LOG) | _t().rlike(COMBINED_LOG)
    )
    digits = F.coalesce(_key("event_id").rlike(r"^\d+$"), F.lit(False))
    authentication = F.when(
        obj,
        _is("source_type", "authentication") | _is("source", *AUTH_SOURCES) | has("EventID") | digits
        | has("TargetUserName") | _t().contains("ConsoleLogin"),
    ).otherwise(
        ~_t().startswith("<")
        & (
            _t().contains("EventID") | _t().contains("pam_unix") | _t().contains("Failed password")
            | _t().contains("Accepted password") | _t().contains("ConsoleLogin")
        )
    )
    return {
        "suricata": suricata, "email": email, "syslog": syslog, "application": application,
        "authentication": authentication, "json": has_json,
    }


#: fields a payload of a registered format must have
REQUIRED = ("timestamp", "source", "source_type", "event_type")
#: and those it may have
OPTIONAL = ("severity", "source_ip", "destination_ip", "source_port", "destination_port", "username", "hostname",
            "domain", "url", "hash", "protocol", "action", "status", "metadata")


@dataclass(frozen=True)
class Format:
    """A parser and normaliser pair as columns over ``raw`` (the payload's text).

    ``accepts`` says which payloads it takes; ``fields`` gives the canonical fields, as texts (``metadata``:
    a map of texts). Times, severities, addresses and ports are normalised as those of the built-in formats.
    A payload for which a required field is null is refused and becomes a dead letter.
    Under the name of a built-in format it takes that one's place; ``accepts`` may then be left out.
    """

    fields: dict[str, Column]
    accepts: Column | None = None
    parser_name: str = "custom_parser"
    parser_version: str = "1.0.0"

    def __post_init__(self):
        missing, odd = [f for f in REQUIRED if f not in self.fields], sorted(set(self.fields) - {*REQUIRED, *OPTIONAL})
        if missing or odd:
            raise ValueError(f"fields missing: {missing}, not known: {odd}")


class Formats(dict[str, Format]):
    """Registered formats, by name in lower case; they are tried in the order of registering, after the built-in ones."""

    def register(self, name: str, form: Format) -> Formats:
        name = name.strip().lower()
        if name in ("", "unknown") or form.accepts is None and name not in PARSERS:
            raise ValueError(f"format {name!r} needs a name of its own and a test of what it accepts")
        self[name] = form
        return self

    def missing(self) -> Column:
        """Names of the required fields that the row's format does not find (null for other formats)."""
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, form in self.items():
            absent = F.concat_ws(", ", *[F.when(form.fields[f].isNull(), f) for f in REQUIRED])
            out = out.when(F.col("format") == name, F.nullif(absent, F.lit("")))
        return out

    def over(self, built_in: Column, field: str, kind: str = "string") -> Column:
        """The field of the row's registered format, else the built-in one."""
        out = built_in
        for name, form in self.items():
            out = F.when(F.col("format") == name, form.fields.get(field, F.lit(None)).cast(kind)).otherwise(out)
        return out


def detect_format(extra: dict[str, Column | Format] | None = None) -> Column:
    """First format that accepts, in the fixed order; added formats come after the built-in ones."""
    tests = {**accepts(), **{name: test for name, form in (extra or {}).items() if (test := form.accepts if isinstance(form, Format) else form) is not None}}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in (*DETECTION_ORDER, *[name for name in tests if name not in DETECTION_ORDER]):
        out = out.when(tests[name], name)
    return out.otherwise("unknown")


def open_payload(raw: DataFrame, formats: dict[str, Column | Format] | None = None) -> DataFrame:
    """Read each payload once: JSON variant, trimmed text, object flag, resolved format."""
    cols = raw.columns
    hint = F.lower(F.trim(F.col("source_type"))) if "source_type" in cols else F.lit(None).cast("string")
    kind = F.col("payload_kind") if "payload_kind" in cols else F.lit(None).cast("string")
    keep = [c for c in cols if c not in ("source_type", "payload_kind")]
    known = F.when(hint.isin(*PARSERS, *[n for n, form in (formats or {}).items() if isinstance(form, Format)]), hint)
    opened = raw.select(
        *keep, known.alias("_hint"), kind.alias("_kind"), F.trim(F.col("raw")).alias("_t"),
        X.json_object("raw").alias("_v"),
    )
    is_object = F.coalesce(F.col("_kind") == "object", _v().isNotNull()) & _v().isNotNull()
    return opened.withColumn("_object", is_object)


def _filled_group(c: Column) -> Column:
    """Group text; null when the group took no part."""
    return F.when(c != "", c)


def _syslog_line() -> dict[str, Column]:
    """Header parts of a syslog line; RFC 5424 is tried first."""
    line = F.when(F.col("_object"), F.coalesce(_j("message"), _t())).otherwise(_t())
    new, old = line.rlike(RFC5424), line.rlike(RFC3164)
    part = lambda i5, i3: F.when(new, X.group(line, RFC5424, i5)).when(old, X.group(line, RFC3164, i3))
    return {
        "_pri": part(1, 1), "_sys_ts": part(2, 2), "_sys_host": part(3, 3),
        "_app": F.coalesce(part(4, 4), F.lit("syslog")), "_pid": part(5, 5),
        "_msg": F.when(new, F.regexp_extract(line, RFC5424, 8)).when(old, F.regexp_extract(line, RFC3164, 6)).otherwise(line),
    }


def _case(st: dict[str, Column | None]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, expr in st.items():
        if expr is not None:
            out = out.when(F.col("format") == name, expr.cast("string"))
    return out


def _windows(i: int) -> Column:
    return lookup(F.col("_win"), {eid: row[i] for eid, row in WINDOWS_EVENTS.items()})


def parse_payloads(raw: DataFrame, as_of: Column | None = None, formats: dict[str, Column | Format] | None = None) -> DataFrame:
    """Parse every payload; ``parse_error`` is set where the format's parser refuses it.

    ``formats`` adds formats: a :class:`Format` with its own fields, or a bare test that only names the format.

    ``as_of`` replaces the wall clock (timestamps that are missing or unreadable, year of syslog dates).
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    opened = open_payload(raw, formats)
    opened = opened.withColumn("format", F.coalesce(F.col("_hint"), detect_format(formats)))
    carry = [c for c in raw.columns if c not in ("source_type", "payload_kind")]

    sys_line = _syslog_line()
    when_sys = lambda c: F.when(F.col("format") == "syslog", c)
    opened = opened.withColumns({
        **{k: when_sys(v) for k, v in sys_line.items()},
        "_cl": F.when((F.col("format") == "application") & _v().isNull(), X.groups(_t(), COMBINED_LOG, 11)),  # an access line is taken apart once
    })
    opened = once(opened)

    msg, app = F.col("_msg"), F.lower(F.col("_app"))
    branch = (
        F.when(app.contains("sshd") | F.lower(msg).contains("sshd"),
               F.when(msg.rlike(SSHD_FAILED), "ssh_failed").when(msg.rlike(SSHD_ACCEPTED), "ssh_ok")
               .when(msg.rlike(SSHD_INVALID_USER), "ssh_invalid").otherwise("ssh_other"))
        .when(app.contains("ufw") | msg.contains("[UFW "), F.when(msg.rlike(UFW), "ufw").otherwise("ufw_other"))
        .when(app.contains("sudo") | F.lower(msg).contains("sudo:"),
              F.when(msg.rlike(SUDO_AUTH_FAIL), "sudo_fail").when(msg.rlike(SUDO), "sudo"))
        .when(msg.rlike(PAM_AUTH_FAIL), "pam")
    )
    app_shape = (
        F.when(_v().isNotNull(), "json").when(F.size("_cl") > 11, "combined").when(_t().rlike(APP_LOG), "line").otherwise("plain")
    )
    auth_shape = (
        F.when(_v().isNotNull(), "json").when(_t().rlike(TEXT_AUTH_FAILED), "failed").when(_t().rlike(TEXT_AUTH_OK), "ok").otherwise("plain")
    )
    opened = opened.withColumns({
        "_br": when_sys(branch),
        "_shape": F.when(F.col("format") == "application", app_shape).when(F.col("format") == "authentication", auth_shape)
        .when(F.col("format") == "email", F.when(_v().isNotNull(), "json").otherwise("plain")),
        "_win": F.when(F.col("format") == "authentication", F.trim(_any("EventID", "event_id", "EventId")).try_cast("int")),
        "_uri": _filled_group(F.get("_cl", F.lit(6))),
        "_code": _filled_group(F.get("_cl", F.lit(8))).try_cast("int"),
    })

    br, shape = F.col("_br"), F.col("_shape")
    ssh = lambda i: (
        F.when(br == "ssh_failed", X.group(msg, SSHD_FAILED, i)).when(br == "ssh_ok", X.group(msg, SSHD_ACCEPTED, i))
    )
    web = lambda i: F.when(shape == "combined", _filled_group(F.get("_cl", F.lit(i))))
    line = lambda i: F.when(shape == "line", X.group(_t(), APP_LOG, i))

    # --- suricata -------------------------------------------------------------
    alert = lambda k: _filled_at(f"alert.{k}")
    eve = F.lower(F.coalesce(_key("event_type"), F.lit("alert")))
    eve_action = F.coalesce(alert("action"), _j("action"), F.lit("alert"))
    http_host, http_url = _at("http.hostname"), _at("http.url")
    http_object = F.coalesce(X.json_type(_v(), "http").startswith("OBJECT"), F.lit(False))
    eve_url = F.when(
        http_object,
        F.when(F.coalesce(http_host, F.lit("")) != "", F.concat(F.lit("http://"), http_host, F.coalesce(http_url, F.lit(""))))
        .when(F.coalesce(http_url, F.lit("")) != "", http_url),
    ).otherwise(_key("url"))

    # --- e-mail ---------------------------------------------------------------
    sender = _any("sender", "from", "from_address", "envelope_from")
    spf = F.lower(F.coalesce(_any("spf_result", "spf"), F.lit("none")))
    dkim = F.lower(F.coalesce(_any("dkim_result", "dkim"), F.lit("none")))
    dmarc = F.lower(F.coalesce(_any("dmarc_result", "dmarc"), F.lit("none")))
    verdict = F.lower(F.coalesce(_any("threat_verdict", "verdict", "action"), F.lit("clean")))
    score_text = F.when(_has("phishing_score"), _key("phishing_score")).otherwise(_key("spam_score"))
    mail_score = F.coalesce(score_text.try_cast("double"), F.lit(0.0))
    phishing = verdict.isin("phishing", "malicious", "spam", "quarantined") | (mail_score >= 0.7)
    mail_auth_bad = spf.isin("fail", "softfail") | (dkim == "fail") | dmarc.isin("fail", "reject", "quarantine")
    mail_class = F.when(phishing, "phishing").when(mail_auth_bad, "auth").otherwise("clean")
    first_item = lambda *names: F.coalesce(*[
        F.expr(_filled_sql(f"try_variant_get(_v, \"$['{n}'][0]\", 'string')")) for n in names
    ])

    # --- authentication -------------------------------------------------------
    auth_name = F.lower(F.coalesce(_any("eventName", "event_type"), F.lit("auth_event")))
    auth_fail = auth_name.contains("fail") | _is("status", "failure", "failed", "denied")
    auth = lambda i, bad, good: F.when(shape == "json", F.coalesce(_windows(i), F.when(auth_fail, bad).otherwise(good)))
    auth_text = lambda bad, good, none: F.when(shape == "failed", bad).when(shape == "ok", good).otherwise(none)

    # --- application ----------------------------------------------------------
    code = F.col("_code")
    sqli, xss = F.col("_uri").rlike(URI_SQLI), F.col("_uri").rlike(URI_XSS)
    web_type = (
        F.when(sqli, "web_sqli_attempt").when(xss, "web_xss_attempt").when(code == 401, "web_unauthorized")
        .when(code == 403, "web_forbidden").when(code == 404, "web_not_found").when(code >= 500, "web_server_error")
        .otherwise("web_access")
    )
    web_sev = F.when(sqli | xss | (code >= 500), "high").when(code.isin(401, 403), "medium").otherwise("low")
    line_sev = map_severity(line(2))
    line_high = line_sev.isin("high", "critical")
    method = _any("method", "http_method")
    app_level = F.coalesce(
        F.when(_j("level").isNotNull(), _key("level", "variant")),
        F.when(_j("severity").isNotNull(), _key("severity", "variant")),
    )

    # raw value of the level, kept as variant so that a JSON number stays one
    level_value = (
        F.when(F.col("format") == "suricata", F.coalesce(
            F.when(alert("severity").isNotNull(), _at("alert.severity", "variant")),
            F.when(_j("severity").isNotNull(), _key("severity", "variant"))))
        .when((F.col("format") == "application") & (shape == "json"), app_level)
        .when(F.col("format") == "json", _alias("severity", "variant"))
    )
    # the value under the first time name in use
    time_names = lambda *names: F.coalesce(*[
        F.expr(f"CASE WHEN {_filled_sql(_key_sql(n))} IS NOT NULL THEN {_key_sql(n, 'variant')} END") for n in names
    ])
    time_value = (
        F.when(F.col("format") == "suricata", time_names("timestamp", "@timestamp"))
        .when(F.col("format") == "application", time_names("timestamp", "time", "@timestamp"))
        .when(F.col("format") == "authentication", time_names("TimeCreated", "timestamp", "@timestamp", "eventTime"))
        .when(F.col("format") == "email", time_names("timestamp", "date", "@timestamp"))
        .when(F.col("format") == "json", _alias("timestamp", "variant"))
    )

    picked = opened.select(
        *carry, "format", "_v", "_t", "_object", "_win", "_shape",
        level_value.alias("_level"), time_value.alias("_time"),
        _case({"syslog": F.col("_sys_ts"),
               "application": F.when(shape == "combined", web(4)).when(shape == "line", line(1))}).alias("_ts_text"),
        _case({
            "suricata": F.when(eve == "alert", "network_ids_alert").otherwise(F.concat(F.lit("network_"), eve)),
            "syslog": F.when(br.isin("ssh_failed", "sudo_fail", "pam"), "auth_failed").when(br == "ssh_ok", "auth_success")
            .when(br == "ssh_invalid", "auth_invalid_user").when(br == "ufw", "firewall_drop").when(br == "sudo", "privilege_escalation")
            .otherwise("syslog_generic"),
            "application": F.when(shape == "json", F.lower(F.coalesce(_j("event_type"), F.when(method.isNotNull(), "web_access").otherwise("app_log"))))
            .when(shape == "combined", web_type).when(shape == "line", F.when(line_high, "app_error").otherwise("app_log"))
            .otherwise("app_log_generic"),
            "authentication": F.coalesce(auth(0, F.lit("auth_failed"), F.lit("auth_success")), auth_text(F.lit("auth_failed"), F.lit("auth_success"), F.lit("auth_event"))),
            "email": F.when(shape == "plain", "email_auth_log").when(mail_class == "phishing", "email_phishing_detected")
            .when(mail_class == "auth", "email_auth_failure").otherwise("email_delivered"),
            "json": F.lower(F.coalesce(_alias("event_type", filled=True), F.lit("json_security_event"))),
        }).alias("event_type"),
        # severities that do not come from a level word
        _case({
            "syslog": F.when(br.isin("ssh_failed", "ssh_invalid"), "medium").when(br.isin("ssh_ok", "ssh_other", "ufw_other", "sudo"), "low")
            .when(br == "ufw", F.when(F.upper(X.group(msg, UFW, 1)) == "BLOCK", "medium").otherwise("low"))
            .when(br.isin("sudo_fail", "pam"), "high")
            .otherwise(F.coalesce(lookup(F.col("_pri").try_cast("int").bitwiseAND(7), {0: "critical", 1: "critical", 2: "high", 3: "medium"}), F.lit("low"))),
            "application": F.when(shape == "combined", web_sev).when(shape == "line", line_sev).when(shape == "plain", "low"),
            "authentication": F.coalesce(auth(1, F.lit("high"), F.lit("low")), auth_text(F.lit("high"), F.lit("low"), F.lit("low"))),
            "email": F.when(shape == "plain", F.when(F.lower(_t()).contains("fail"), "medium").otherwise("low"))
            .when(mail_class == "phishing", "high").when(mail_class == "auth", "medium").otherwise("low"),
        }).alias("_fixed_sev"),
        _case({
            "suricata": _key("src_ip"),
            "syslog": F.when(br.isin("ssh_failed", "ssh_ok"), ssh(2)).when(br == "ssh_invalid", X.group(msg, SSHD_INVALID_USER, 2))
            .when(br == "ufw", X.group(msg, UFW, 4)).when(br == "sudo_fail", X.group(msg, SUDO_AUTH_FAIL, 1)).when(br == "pam", X.group(msg, PAM_AUTH_FAIL, 2)),
            "application": F.when(shape == "json", _any("client_ip", "ip", "source_ip")).otherwise(web(1)),
            "authentication": F.when(shape == "json", _any("IpAddress", "src_ip", "source_ip", "sourceIPAddress", "client_ip"))
            .when(shape == "failed", X.group(_t(), TEXT_AUTH_FAILED, 2)).when(shape == "ok", X.group(_t(), TEXT_AUTH_OK, 2)),
            "email": _any("client_ip", "src_ip", "sender_ip", "connecting_ip"),
            "json": _alias("source_ip"),
        }).alias("_src_ip"),
        _case({"suricata": _key("dest_ip"), "syslog": F.when(br == "ufw", X.group(msg, UFW, 5)),
               "json": _alias("destination_ip")}).alias("_dst_ip"),
        _case({"suricata": _key("src_port"), "syslog": F.when(br == "ufw", X.group(msg, UFW, 7)).otherwise(ssh(3)),
               "authentication": _any("IpPort", "src_port"), "json": _alias("source_port")}).alias("_src_port"),
        _case({"suricata": _key("dest_port"), "syslog": F.when(br == "ufw", X.group(msg, UFW, 8)),
               "json": _alias("destination_port")}).alias("_dst_port"),
        _case({"suricata": F.upper(F.coalesce(_j("proto"), F.lit("TCP"))), "syslog": F.when(br == "ufw", F.upper(X.group(msg, UFW, 6))),
               "json": F.upper(_alias("protocol", filled=True))}).alias("protocol"),
        _case({
            "syslog": F.when(br.isin("ssh_failed", "ssh_ok"), ssh(1)).when(br == "ssh_invalid", X.group(msg, SSHD_INVALID_USER, 1))
            .when(br == "sudo_fail", X.group(msg, SUDO_AUTH_FAIL, 2)).when(br == "sudo", X.group(msg, SUDO, 1)).when(br == "pam", X.group(msg, PAM_AUTH_FAIL, 3)),
            "application": F.when(shape == "json", _any("user", "username")).otherwise(F.nullif(web(3), F.lit("-"))),
            "authentication": F.when(shape == "json", F.coalesce(
                _any("TargetUserName", "username", "user", "SubjectUserName", "userName"), _filled_at("userIdentity.userName")))
            .when(shape == "failed", X.group(_t(), TEXT_AUTH_FAILED, 1)).when(shape == "ok", X.group(_t(), TEXT_AUTH_OK, 1)),
            "email": sender,
            "json": _alias("username", filled=True),
        }).alias("username"),
        _case({"suricata": F.coalesce(_j("hostname"), X.not_blank(http_host), _filled_at("tls.sni")),
               "syslog": F.col("_sys_host"), "authentication": _any("WorkstationName", "Computer", "hostname"),
               "json": _alias("hostname", filled=True)}).alias("hostname"),
        _case({"authentication": _any("TargetDomainName", "domain", "SubjectDomainName"),
               "email": F.when(sender.contains("@"), F.trim(F.element_at(F.split(sender, "@"), -1))),
               "json": _alias("domain", filled=True)}).alias("domain"),
        _case({"suricata": eve_url, "application": F.when(shape == "json", _any("url", "uri", "path")).otherwise(F.col("_uri")),
               "email": first_item("urls", "extracted_urls"), "json": _alias("url", filled=True)}).alias("url"),
        _case({"email": F.coalesce(first_item("attachment_hashes", "file_hashes"), _j("attachment_hash")),
               "json": _alias("hash", filled=True)}).alias("hash"),
        _case({
            "suricata": F.lower(eve_action),
            "syslog": F.when(br.isin("ssh_failed", "ssh_invalid", "sudo_fail", "pam"), "denied").when(br == "ssh_ok", "allowed")
            .when(br == "ufw", F.when(F.upper(X.group(msg, UFW, 1)) == "BLOCK", "blocked").otherwise("allowed")).when(br == "sudo", "executed").otherwise("logged"),
            "application": F.when(shape == "json", F.coalesce(_key("action"), F.lit("allowed")))
            .when(shape == "combined", F.when(code == 401, "denied").when(code == 403, "blocked").otherwise("allowed")),
            "authentication": F.coalesce(auth(2, F.lit("denied"), F.lit("allowed")), auth_text(F.lit("denied"), F.lit("allowed"), F.lit("logged"))),
            "email": F.when(shape == "plain", "logged").when(mail_class == "phishing", F.when(verdict.contains("quarantin"), "quarantined").otherwise("blocked"))
            .when(mail_class == "auth", "flagged").otherwise("delivered"),
            "json": F.lower(_alias("action", filled=True)),
        }).alias("action"),
        _case({
            "suricata": F.when(eve == "alert", "triggered").otherwise("success"),
            "syslog": F.when(br.isin("ssh_failed", "ssh_invalid", "sudo_fail", "pam"), "failure").when(br.isin("ssh_ok", "sudo"), "success")
            .when(br == "ufw", F.when(F.upper(X.group(msg, UFW, 1)) == "BLOCK", "blocked").otherwise("allowed"))
            .when(br.isin("ssh_other", "ufw_other"), "info").otherwise("informational"),
            "application": F.when(shape == "json", F.coalesce(_any("status_code", "status"), F.lit("info")))
            .when(shape == "combined", F.when(code < 400, "success").otherwise("failure")).when(shape == "line", F.when(line_high, "error").otherwise("info")),
            "authentication": F.coalesce(auth(3, F.lit("failure"), F.lit("success")), auth_text(F.lit("failure"), F.lit("success"), F.lit("success"))),
            "email": F.when(shape == "plain", "info").when(mail_class == "phishing", "detected").when(mail_class == "auth", "warning").otherwise("success"),
            "json": F.lower(_alias("status", filled=True)),
        }).alias("status"),
        # what the naming step needs
        _case({"syslog": F.concat(F.lit("syslog."), F.col("_app")),
               "suricata": F.lit("suricata"),
               "application": F.concat(F.lit("application."), F.coalesce(
                   F.when(shape == "json", _any("logger", "source")), F.when(shape == "line", F.coalesce(line(3), F.lit("root"))), F.lit("webapp"))),
               "authentication": F.when((shape == "json") & (F.col("_win") != 0), F.concat(F.lit("windows_security_event_"), F.col("_win").cast("string")))
               .otherwise(F.coalesce(F.when(shape == "json", _key("source")), F.lit("authentication_service"))),
               "email": F.coalesce(F.when(shape == "json", _j("source")), F.lit("email_gateway")),
               "json": F.coalesce(_any("source", "vendor"), F.lit("json_stream"))}).alias("source"),
        _case({"suricata": F.lit("network_ids"), "syslog": F.lit("syslog"), "application": F.lit("application_log"),
               "authentication": F.lit("authentication"), "email": F.lit("email_security"),
               "json": F.coalesce(_j("source_type"), F.lit("generic_json"))}).alias("source_type"),
        _metadata(eve, eve_action, alert, sender, spf, dkim, dmarc, mail_score, verdict, web, line, sqli, xss, br, shape).alias("metadata"),
    )

    picked = once(picked)
    level_word = F.try_variant_get("_level", "$", "string")
    default = F.when(F.col("format") == "suricata", "medium").otherwise("low")
    severity = F.coalesce(F.col("_fixed_sev"), map_severity(level_word, default, _int_if_number(F.col("_level"))), default)
    ts_text = F.coalesce(F.col("_ts_text"), F.try_variant_get("_time", "$", "string"))
    own = Formats({name: form for name, form in (formats or {}).items() if isinstance(form, Format)})
    given = F.col("format").isin(*own) if own else F.lit(False)
    refused = F.when(F.col("format").isin("suricata", "json") & ~given & F.col("_v").isNull(),
                     F.concat(F.lit("Parsing exception: "), F.coalesce(X.json_error("_t"), F.lit("Invalid JSON syntax"))))
    if own:
        refused = F.when(own.missing().isNotNull(), F.concat(F.lit("Parsing exception: no "), own.missing())).otherwise(refused)
        severity = F.when(given, F.coalesce(map_severity(own.over(F.lit(None).cast("string"), "severity"), F.lit("low")), F.lit("low"))).otherwise(severity)
    text = lambda name, at=None: own.over(F.col(at or name), name)
    named = lambda i: lookup("format", {**{k: v[i] for k, v in PARSERS.items()}, **{k: (f.parser_name, f.parser_version)[i] for k, f in own.items()}})
    return picked.select(
        *carry, "format", "_object", "_v",
        refused.alias("parse_error"),
        X.parse_ts(own.over(ts_text, "timestamp"), as_of, F.when(~given, _double_if_number(F.col("_time"))) if own else _double_if_number(F.col("_time"))).alias("timestamp"),
        text("source").alias("source"), text("source_type").alias("source_type"), text("event_type").alias("event_type"), severity.alias("severity"),
        norm_ip(text("source_ip", "_src_ip")).alias("source_ip"), norm_ip(text("destination_ip", "_dst_ip")).alias("destination_ip"),
        norm_port(text("source_port", "_src_port")).alias("source_port"), norm_port(text("destination_port", "_dst_port")).alias("destination_port"),
        *[text(c).alias(c) for c in ("username", "hostname", "domain", "url", "hash", "protocol", "action", "status")],
        F.map_filter(F.coalesce(own.over(F.col("metadata"), "metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()).alias("metadata"),
        named(0).alias("parser_name"),
        F.coalesce(named(1), F.lit("1.0.0")).alias("parser_version"),
    )


def _metadata(eve, eve_action, alert, sender, spf, dkim, dmarc, mail_score, verdict, web, line, sqli, xss, br, shape) -> Column:
    """Context per format as a string map; JSON payloads keep their own keys under the added ones."""
    pairs = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v.cast("string"))])
    own = F.coalesce(F.try_variant_get(_v(), "$", "map<string,string>"), F.create_map().cast("map<string,string>"))

    def over(extra: dict[str, Column]) -> Column:
        return F.map_concat(F.map_filter(own, lambda k, v: ~k.isin(*extra)), pairs(extra))

    blocks = {b: _key(b) for b in ("http", "dns", "tls", "smtp", "flow", "payload")}
    fmt = F.col("format")
    return (
        F.when(fmt == "suricata", pairs({
            "suricata_event_type": eve, "signature": F.coalesce(alert("signature"), alert("signature_id"), _j("signature")),
            "category": F.coalesce(alert("category"), _j("category"), F.lit("Network Security Event")), "action": eve_action,
            "flow_id": _key("flow_id"), "in_iface": _key("in_iface"), "app_proto": _key("app_proto"),
            "pcap_cnt": _key("pcap_cnt"), "community_id": _key("community_id"), **blocks}))
        .when(fmt == "syslog", pairs({
            "hostname": F.col("_sys_host"), "app_name": F.col("_app"), "pid": F.col("_pid"), "pri": F.col("_pri"), "message": F.col("_msg"),
            "target_user": F.when(br == "sudo", X.group("_msg", SUDO, 2)), "command": F.when(br == "sudo", X.group("_msg", SUDO, 3))}))
        .when(fmt == "application", F.when(shape == "json", own)
              .when(shape == "combined", pairs({
                  "http_method": web(5), "status_code": web(8), "uri": web(6), "protocol": web(7),
                  "referrer": F.nullif(web(10), F.lit("-")), "user_agent": F.nullif(web(11), F.lit("-")),
                  "is_sqli_pattern": sqli, "is_xss_pattern": xss}))
              .when(shape == "line", pairs({"logger": F.coalesce(line(3), F.lit("root")), "level": line(2), "message": line(4)}))
              .otherwise(pairs({"message": _t()})))
        .when(fmt == "authentication", F.when(shape == "json", over({
            "windows_event_id": F.when(F.col("_win") != 0, F.col("_win")),
            "logon_type_desc": lookup(F.coalesce(_any("LogonType", "logon_type"), F.lit("")), LOGON_TYPES)}))
            .otherwise(pairs({"raw_message": _t()})))
        .when(fmt == "email", F.when(shape == "json", over({
            "sender": sender, "recipient": _any("recipient", "to", "to_address", "envelope_to"),
            "subject": F.coalesce(_any("subject", "email_subject"), F.lit("")), "spf_result": spf, "dkim_result": dkim,
            "dmarc_result": dmarc, "phishing_score": mail_score, "threat_verdict": verdict}))
            .otherwise(pairs({"message": _t()})))
        .when(fmt == "json", over({"parsed_as": F.lit("generic_json")}))
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def source_catalogue(spark, formats: Formats | None = None) -> DataFrame:
    """Supported formats, registered ones included, with parser name and version (VAL-06)."""
    rows = [(name, *info) for name, info in {**PARSERS, **{n: (f.parser_name, f.parser_version) for n, f in (formats or {}).items()}}.items()]
    return spark.createDataFrame(rows, "source_type string, parser_name string, parser_version string")
