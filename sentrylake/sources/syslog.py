"""Landed syslog pages to events.

Landing layout: ``<path>/device=<id>/*.json``, each file one page ``{total, logs: [{timestamp,
program, msg, seq, level}]}``. Parsing is column expressions only: an ordered list of rules, of
which the first that fits decides what a line becomes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.functions.net import bind
from sentrylake.functions.scalars import (
    dedup_key,
    lookup,
    normalize_protocol,
    syslog_severity,
)
from sentrylake.profile import Profile
from sentrylake.schema import EVENT_SCHEMA, conform, conform_events
from sentrylake.sources.common import assign_zones, dedup_events, first_match, whole_files

SOURCE = "syslog"

PAGE_SCHEMA = (
    "total bigint, logs array<struct<timestamp: string, program: string, msg: string, "
    "message: string, seq: string, id: string, level: string>>"
)

# Line formats of the supported programs.
FIREWALL_ACTION = r"(?i)^\s*(?:\[[^\]]*\]\s*)?(DROP|ACCEPT|REJECT)\b"
FIREWALL_FIELD = r"\b(IN|OUT|SRC|DST|LEN|TTL|PROTO|SPT|DPT|MAC)=(\S*)"
MAC = r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
DHCP_LINE = r"^(DHCPACK|DHCPREQUEST|DHCPOFFER|DHCPDISCOVER|DHCPRELEASE|DHCPINFORM)\([^)]*\)\s*(.*)$"
DNS_QUERY_LINE = r"^\d+\s+(\S+?)/\d+\s+query\[([A-Za-z0-9]+)\]\s+(\S+)\s+from\s+\S+\s*$"
LUCI_LOGIN = r"(?i)^\[info\]\s+luci:\s+(accepted|failed)\s+login\s+on\s+\S+\s+for\s+(\S+)\s+from\s+(\S+)"
WEB_LOGIN = r"(?i)^\[LOGIN\]\[http\]\[Web\]\s+(success\w*|fail\w*)\s+\(([\d.]+)\)"
SSH_ACCEPTED = rf"^Accepted (\S+) for (\S+) from ({IPV4}) port (\d+)"
SSH_FAILED = rf"^Failed (\S+) for (?:invalid user )?(\S+) from ({IPV4}) port (\d+)"
SSH_INVALID = rf"^Invalid user (\S+) from ({IPV4})"
SSH_OPEN = r"session opened for user ([^\s(]+)"
SSH_CLOSE = r"session closed for user ([^\s(]+)"
DROPBEAR_ACCEPTED = rf"^(?:Password|Pubkey) auth succeeded for '([^']+)'.* from ({IPV4}):(\d+)"
DROPBEAR_BAD_PASSWORD = rf"^Bad password attempt for '([^']+)' from ({IPV4}):(\d+)"
DROPBEAR_MAX_TRIES = (
    rf"^Exit before auth from <({IPV4}):(\d+)>: Max auth tries reached - user '(.+)'$"
)
DEFENDER_PREFIX = (
    "Microsoft Defender Antivirus has detected malware or other potentially unwanted software"
)

# First sentence of a Windows audit event, its action, and the section that names
# the account ("" for the whole text; the first section present is used).
WINDOWS_EVENTS = (
    ("An account was successfully logged on", "logon_success",
     ("Account For Which Logon Failed:", "New Logon:", "")),
    ("An account failed to log on", "logon_failed",
     ("Account For Which Logon Failed:", "New Logon:", "")),
    ("Special privileges assigned to new logon", "privileged", ("",)),
    ("A logon was attempted using explicit credentials", "explicit_creds",
     ("Account Whose Credentials Were Used:",)),
    ("A user account was locked out", "lockout", ("Account That Was Locked Out:",)),
)
WINDOWS_LOGON_TYPES = {
    "2": "interactive", "3": "network", "4": "batch", "5": "service",
    "7": "unlock", "8": "net_clear", "9": "new_cred", "10": "rdp",
    "11": "cached",
}
SSH_METHODS = {
    "password": "password", "publickey": "publickey", "none": "none",
    "keyboard-interactive": "kbdint", "keyboard-interactive/pam": "kbdint",
}

_FIELDS = {
    "kind": "string", "action": "string", "proto": "string", "iface_in": "string",
    "iface_out": "string", "src_ip": "string", "src_port": "int", "dst_ip": "string",
    "dst_port": "int", "ttl": "int", "pkt_len": "int", "user": "string", "client_ip": "string",
    "domain": "string", "qtype": "string", "blocked": "boolean",
}


def read_syslog_landing(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed line: ``device, timestamp, program, msg, seq, level`` and ingest order."""
    pages = (
        whole_files(spark)
        .option("basePath", path)
        .schema(f"{PAGE_SCHEMA}, device string")
        .json(f"{path}/device=*")
    )
    lines = pages.select(
        F.col("device").cast("string").alias("device"),
        F.col("_metadata.file_path").alias("file"),
        "total",
        F.posexplode("logs").alias("pos", "log"),
    )
    text = F.coalesce(F.nullif(F.col("log.msg"), F.lit("")), F.col("log.message"))
    seq = F.coalesce(F.nullif(F.nullif(F.col("log.seq"), F.lit("")), F.lit("0")), F.col("log.id"))
    return lines.select(
        "device", "file", "pos", "total", "log.timestamp", "log.program",
        text.alias("msg"), seq.alias("seq"), "log.level",
    )


def reported_totals(lines: DataFrame) -> DataFrame:
    """What the log server reported per device, to be checked against what arrived."""
    return lines.groupBy("device").agg(F.max("total").alias("reported"))


def parse_timestamp(raw: Column) -> Column:
    """Seconds since the epoch or one of three text forms; null when it is neither."""
    number = F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.try_cast("double"))
    text = F.replace(F.trim(raw), F.lit("T"), F.lit(" "))
    text = F.trim(F.replace(F.split_part(text, F.lit("."), F.lit(1)), F.lit("Z"), F.lit("")))
    forms = [
        F.try_to_timestamp(text, F.lit(form)) for form in ("y-M-d H:m:s", "y-M-d H:m", "y-M-d")
    ]
    return F.coalesce(F.timestamp_micros((number * 1_000_000).cast("bigint")), *forms)


@dataclass(frozen=True)
class Rule:
    """One line format: which lines it fits, and what fields they yield."""

    name: str
    fits: Column
    kind: str
    fields: dict[str, Column]


def _int(text: Column) -> Column:
    return text.try_cast("int")


def is_firewall_line(program: Column, msg: Column) -> Column:
    return (program == "KERNEL") & msg.rlike(FIREWALL_ACTION)


def firewall_rules(program: Column, msg: Column, names: Column, values: Column) -> list[Rule]:
    """Kernel packet line; ``names`` and ``values`` are its KEY=VALUE parts from last to first, so
    that a repeated field counts with its last value."""

    def value(name: str) -> Column:
        at = F.array_position(names, name).cast("int")
        return F.nullif(F.when(at > 0, F.get(values, at - 1)), F.lit(""))

    fields = {
        "action": F.lower(F.regexp_extract(msg, FIREWALL_ACTION, 1)),
        "proto": normalize_protocol(value("PROTO")),
        "iface_in": value("IN"),
        "iface_out": value("OUT"),
        "src_ip": value("SRC"),
        "dst_ip": value("DST"),
        "src_port": _int(value("SPT")),
        "dst_port": _int(value("DPT")),
        "ttl": _int(value("TTL")),
        "pkt_len": _int(value("LEN")),
    }
    return [Rule("firewall", is_firewall_line(program, msg), "firewall", fields)]


def vpn_rules(program: Column) -> list[Rule]:
    fits = program.startswith("VPNSERVER") | program.isin("OPENVPN", "PPTPD")
    return [Rule("vpn", fits, "auth", {})]


def deauth_rules(program: Column, msg: Column) -> list[Rule]:
    mac = rf"\b({MAC})\b"
    fits = (
        program.isin("WLCEVENTD", "HOSTAPD") & F.lower(msg).contains("deauth") & msg.rlike(mac)
    )
    fields = {"action": F.lit("deauth"), "user": F.lower(F.regexp_extract(msg, mac, 1))}
    return [Rule("deauth", fits, "auth", fields)]


def dhcp_lease(msg: Column) -> dict[str, Column]:
    """Parts of a lease line: verb, and optional address, hardware address and host name."""
    line = F.trim(msg)
    words = F.split(F.trim(F.regexp_extract(line, DHCP_LINE, 2)), r"\s+")
    word = lambda i: F.get(words, i)
    has_ip = F.coalesce(word(F.lit(0)).rlike(f"^{IPV4}$"), F.lit(False))
    next_ = F.when(has_ip, 1).otherwise(0)
    mac = F.when(word(next_).rlike(f"^{MAC}$"), F.lower(word(next_)))
    return {
        "verb": first_match(line, DHCP_LINE),
        "ip": F.when(has_ip, word(F.lit(0))),
        "mac": mac,
        "hostname": F.nullif(word(next_ + F.when(mac.isNotNull(), 1).otherwise(0)), F.lit("")),
    }


def dhcp_rules(program: Column, msg: Column) -> list[Rule]:
    lease = dhcp_lease(msg)
    fits = (program == "DNSMASQ-DHCP") & lease["verb"].isNotNull() & lease["mac"].isNotNull()
    fields = {"action": F.lower(lease["verb"]), "user": lease["mac"], "src_ip": lease["ip"]}
    return [Rule("dhcp", fits, "system", fields)]


def dns_query_rules(program: Column, msg: Column) -> list[Rule]:
    """A client's lookup; the resolver's own start-up test is not one, nor is any answer line."""
    line = F.trim(msg)
    part = lambda i: F.regexp_extract(line, DNS_QUERY_LINE, i)
    fits = (program == "DNSMASQ") & line.rlike(DNS_QUERY_LINE) & (part(1) != "127.0.0.1")
    fields = {
        "client_ip": part(1), "qtype": part(2), "domain": part(3), "blocked": F.lit(False),
    }
    return [Rule("dns_query", fits, "dns", fields)]


def admin_login_rules(program: Column, msg: Column) -> list[Rule]:
    """Web login on a router, in either of two formats."""
    line = F.trim(msg)
    outcome = lambda won: F.when(won, "web_login_success").otherwise("web_login_failed")
    luci = lambda i: F.regexp_extract(line, LUCI_LOGIN, i)
    web = lambda i: F.regexp_extract(line, WEB_LOGIN, i)
    return [
        Rule(
            "luci", (program == "UHTTPD") & line.rlike(LUCI_LOGIN), "auth",
            {"action": outcome(F.lower(luci(1)) == "accepted"), "user": luci(2), "src_ip": luci(3)},
        ),
        Rule(
            "web", (program == "HTTPD") & line.rlike(WEB_LOGIN), "auth",
            {"action": outcome(F.lower(web(1)).startswith("success")), "src_ip": web(2)},
        ),
    ]


def windows_field(section: Column, label: str) -> Column:
    """A labelled value of a rendered audit event; "-" stands for no value."""
    pattern = label + r":(?:\\011)+\s*(\S.*?)(?=\s{2,}\S|\z)"
    found = F.trim(F.regexp_extract(section, pattern, 1))
    return bind(found, lambda v: F.when(~v.isin("", "-"), v))


def windows_account(msg: Column, sections: tuple[str, ...]) -> Column:
    """Account name of the first section that has one."""
    names = []
    for marker in sections:
        if marker:
            at = F.instr(msg, marker)
            names.append(F.when(at > 0, windows_field(F.substr(msg, at), "Account Name")))
        else:
            names.append(windows_field(msg, "Account Name"))
    return F.coalesce(*names)


def windows_rules(program: Column, msg: Column) -> list[Rule]:
    """Logon events, one rule per leading sentence."""
    mine = program.startswith("MICROSOFT-WINDOWS-SECURITY-AUDIT")
    shared = {
        "proto": bind(
            windows_field(msg, "Logon Type"), lambda v: lookup(v, WINDOWS_LOGON_TYPES)
        ),
        "src_ip": windows_field(msg, "Source Network Address"),
    }
    return [
        Rule(
            f"windows_{action}", mine & msg.startswith(sentence), "auth",
            {"action": F.lit(action), "user": windows_account(msg, sections), **shared},
        )
        for sentence, action, sections in WINDOWS_EVENTS
    ]


def defender_rules(program: Column, msg: Column) -> list[Rule]:
    fits = program.startswith("MICROSOFT-WINDOWS-WINDOWS_DEFEND") & msg.startswith(DEFENDER_PREFIX)
    return [Rule("defender", fits, "ids", {"action": F.lit("detection")})]


def openssh_rules(program: Column, msg: Column) -> list[Rule]:
    mine = program.startswith("SSHD")
    part = lambda pattern, i: F.regexp_extract(msg, pattern, i)

    def outcome(name: str, pattern: str) -> Rule:
        fields = {
            "action": F.lit(name),
            "proto": bind(
                part(pattern, 1),
                lambda m: F.coalesce(lookup(m, SSH_METHODS), m),
            ),
            "user": part(pattern, 2),
            "src_ip": part(pattern, 3),
            "src_port": _int(part(pattern, 4)),
        }
        return Rule(name, mine & msg.rlike(pattern), "auth", fields)

    def named(name: str, pattern: str, **more: Column) -> Rule:
        fields = {"action": F.lit(name), "user": part(pattern, 1), **more}
        return Rule(name, mine & msg.rlike(pattern), "auth", fields)

    return [
        outcome("ssh_accepted", SSH_ACCEPTED),
        outcome("ssh_failed", SSH_FAILED),
        named("ssh_invalid", SSH_INVALID, src_ip=part(SSH_INVALID, 2)),
        named("session_open", SSH_OPEN),
        named("session_close", SSH_CLOSE),
    ]


def dropbear_rules(program: Column, msg: Column) -> list[Rule]:
    mine = program == "DROPBEAR"
    part = lambda pattern, i: F.regexp_extract(msg, pattern, i)

    def outcome(name: str, pattern: str) -> Rule:
        fields = {
            "action": F.lit(name), "user": part(pattern, 1), "src_ip": part(pattern, 2),
            "src_port": _int(part(pattern, 3)),
        }
        return Rule(f"dropbear_{name}", mine & msg.rlike(pattern), "auth", fields)

    unknown = part(DROPBEAR_MAX_TRIES, 3) == "is invalid"
    tries = {
        "action": F.when(unknown, "ssh_invalid").otherwise("ssh_failed"),
        "user": F.when(~unknown, part(DROPBEAR_MAX_TRIES, 3)),
        "src_ip": part(DROPBEAR_MAX_TRIES, 1),
        "src_port": _int(part(DROPBEAR_MAX_TRIES, 2)),
    }
    return [
        outcome("ssh_accepted", DROPBEAR_ACCEPTED),
        outcome("ssh_failed", DROPBEAR_BAD_PASSWORD),
        Rule("dropbear_tries", mine & msg.rlike(DROPBEAR_MAX_TRIES), "auth", tries),
    ]


def line_rules(program: Column, msg: Column, names: Column, values: Column) -> list[Rule]:
    """All rules in the order in which they are tried."""
    return [
        *firewall_rules(program, msg, names, values),
        *vpn_rules(program),
        *deauth_rules(program, msg),
        *dhcp_rules(program, msg),
        *dns_query_rules(program, msg),
        *admin_login_rules(program, msg),
        *windows_rules(program, msg),
        *defender_rules(program, msg),
        *openssh_rules(program, msg),
        *dropbear_rules(program, msg),
    ]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (``program`` in upper case, ``msg``) with the event fields they stand for.

    The first projection names the rule a line fits, the second reads each field by that name, so a
    test runs once per line and a field that nobody asks for is never extracted. A line no rule
    knows is a plain system event.
    """
    packet = is_firewall_line(F.col("program"), F.col("msg"))
    parts = lambda group: F.when(
        packet, F.reverse(F.regexp_extract_all("msg", F.lit(FIREWALL_FIELD), F.lit(group)))
    )
    rules = line_rules(F.col("program"), F.col("msg"), F.col("_names"), F.col("_values"))
    tag = reduce(lambda chain, r: chain.when(r.fits, r.name), rules[1:], F.when(rules[0].fits, rules[0].name))
    tagged = lines.withColumns(
        {"_rule": F.coalesce(tag, F.lit("")), "_names": parts(1), "_values": parts(2)}
    )

    def field(name: str, kind: str) -> Column:
        chain = None
        for r in rules:
            value = F.lit(r.kind) if name == "kind" else r.fields.get(name)
            if value is not None:
                chain = (F if chain is None else chain).when(F.col("_rule") == r.name, value)
        if chain is None:
            return F.lit(None).cast(kind)
        return (chain.otherwise("system") if name == "kind" else chain).cast(kind)

    return tagged.select(
        *lines.columns, *[field(n, k).alias(n) for n, k in _FIELDS.items()]
    )


def _key(source: str) -> Column:
    """Record key of a landed line."""
    return dedup_key(source, F.col("device"), F.col("seq"), F.col("timestamp"), F.coalesce("msg", F.lit("")))


def normalize_syslog(lines: DataFrame, profile: Profile, source: str = SOURCE) -> DataFrame:
    """Events of landed lines (``device, timestamp, program, msg, seq, level``), undated lines
    dropped. Ingest order columns (``file, pos``) are kept when present."""
    order = [c for c in ("file", "pos") if c in lines.columns]
    msg = F.coalesce("msg", F.lit(""))
    clean = lines.select(
        parse_timestamp(F.col("timestamp")).alias("ts"),
        _key(source).alias("dedup_key"),
        F.col("device").cast("string").alias("device"),
        F.upper(F.coalesce("program", F.lit(""))).alias("program"),
        syslog_severity("level").alias("severity"),
        msg.alias("msg"),
        *order,
    ).where(F.col("ts").isNotNull())
    rows = parse_lines(clean).withColumns(
        {
            "source": F.lit(source),
            "program": F.nullif("program", F.lit("")),
            "message": F.nullif(F.col("msg"), F.lit("")),
        }
    )
    flat = assign_zones(rows, profile)
    keep = T.StructType([*EVENT_SCHEMA.fields, *[flat.schema[c] for c in order]])
    return conform(flat, keep)


def last_copies(lines: DataFrame, source: str = SOURCE) -> DataFrame:
    """Dated landed lines with one row per record key, the last in ingest order, without that order.

    The key is made of landed fields only, so lines are made distinct before they are parsed: a copy
    is never parsed, and a field that nobody asks for is not extracted for the sake of the choice.
    """
    keyed = lines.where(parse_timestamp(F.col("timestamp")).isNotNull()).withColumn("dedup_key", _key(source))
    return dedup_events(keyed, ["file", "pos"], keep="last").drop("dedup_key", "file", "pos")


def load_syslog(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """Landed pages to distinct events; a line collected twice counts once, the last copy wins."""
    return conform_events(normalize_syslog(last_copies(read_syslog_landing(spark, path).drop("total")), profile))
