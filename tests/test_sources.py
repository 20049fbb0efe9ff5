"""Landed raw input to events."""

from __future__ import annotations

import gzip
import json
from datetime import date, datetime, timezone

import pytest

from sentrylake.operators import match
from sentrylake.profile import Profile, ProfileError
from sentrylake.sources import cloudtrail, dnslog, guardduty, lists, syslog
from sentrylake.sources.window import Window

UTC = timezone.utc
STAMP = "2026-06-01 03:14:15"


def parse(spark, profile, *entries):
    rows = [(e.get("device", "3"), e.get("timestamp", STAMP), e["program"], e["msg"], str(i), e.get("level")) for i, e in enumerate(entries)]
    lines = spark.createDataFrame(rows, "device string, timestamp string, program string, msg string, seq string, level string")
    return syslog.normalize_syslog(lines, profile).collect()


def windows(what, kind, section, account, address):
    return (
        f"{what}    Subject:  \\011Security ID:\\011\\011S-1-5-18  \\011Account Name:\\011\\011HOST$  \\011Account Domain:\\011\\011WG    "
        f"Logon Information:  \\011Logon Type:\\011\\011{kind}    {section}  \\011Security ID:\\011\\011S-1-5-21  \\011Account Name:\\011\\011{account}  "
        f"\\011Account Domain:\\011\\011WG    Network Information:  \\011Source Network Address:\\011{address}  \\011Source Port:\\0110"
    )


def test_firewall_lines(spark, profile):
    drop = "DROP IN=eth0 OUT= MAC=aa:bb SRC=203.0.113.45 DST=198.51.100.9 LEN=60 TOS=0x00 TTL=51 ID=1234 PROTO=TCP SPT=54321 DPT=22"
    wrt = "[4081245.82] drop wan out: IN=eth0 OUT=eth1 SRC=1.1.1.1 SRC=10.10.15.135 DST=10.10.0.90 LEN=52 TTL=127 PROTO=17 SPT=53056 DPT=7680"
    igmp = "DROP IN=br0 SRC=10.10.0.5 DST=224.0.0.1 LEN=32 TTL=1 PROTO=2"
    a, b, c, d = parse(spark, profile, *[{"program": "kernel", "msg": m} for m in (drop, wrt, igmp, "DROPPED nothing")])
    assert (a.kind, a.action, a.src_ip, a.dst_port, a.src_port, a.proto, a.ttl, a.iface_in, a.iface_out) == ("firewall", "drop", "203.0.113.45", 22, 54321, "tcp", 51, "eth0", None)
    assert (b.src_ip, b.proto, b.src_zone, b.dst_zone, b.iface_out) == ("10.10.15.135", "udp", "dmz", "lan", "eth1")
    assert c.proto == "igmp" and c.dst_port is None and d.kind == "system"


def test_logon_lines(spark, profile):
    win = "Microsoft-Windows-Security-Auditi"
    got = parse(
        spark, profile,
        {"program": win, "msg": windows("An account was successfully logged on.", "10", "New Logon:", "alice", "203.0.113.44")},
        {"program": win, "msg": windows("An account failed to log on.", "3", "Account For Which Logon Failed:", "administrator", "198.51.100.9")},
        {"program": win, "msg": windows("An account was successfully logged on.", "5", "New Logon:", "SYSTEM", "-")},
        {"program": win, "msg": "Something else entirely"},
        {"program": "SSHD-SESSION", "msg": "Accepted keyboard-interactive/pam for bob from 10.10.0.7 port 50022 ssh2"},
        {"program": "SSHD", "msg": "Failed password for invalid user eve from 203.0.113.5 port 4 ssh2"},
        {"program": "dropbear", "msg": "Exit before auth from <10.10.0.9:5>: Max auth tries reached - user 'is invalid'"},
        {"program": "dropbear", "msg": "Exit before auth from <10.10.0.9:5>: Exited normally"},
        {"program": "HTTPD", "msg": "[LOGIN][http][Web] successed (10.10.0.5)"},
        {"program": "UHTTPD", "msg": "[info] luci: failed login on /admin for root from 203.0.113.8"},
    )
    assert [(e.kind, e.action, e.user, e.proto, e.src_ip) for e in got] == [
        ("auth", "logon_success", "alice", "rdp", "203.0.113.44"),
        ("auth", "logon_failed", "administrator", "network", "198.51.100.9"),
        ("auth", "logon_success", "SYSTEM", "service", None),
        ("system", None, None, None, None),
        ("auth", "ssh_accepted", "bob", "kbdint", "10.10.0.7"),
        ("auth", "ssh_failed", "eve", "password", "203.0.113.5"),
        ("auth", "ssh_invalid", None, None, "10.10.0.9"),
        ("system", None, None, None, None),
        ("auth", "web_login_success", None, None, "10.10.0.5"),
        ("auth", "web_login_failed", "root", None, "203.0.113.8"),
    ]


def test_lease_query_and_radio_lines(spark, profile):
    got = parse(
        spark, profile,
        {"program": "dnsmasq-dhcp", "msg": "DHCPACK(br-iot) 10.10.50.7 02:AB:CD:00:00:03 camera"},
        {"program": "dnsmasq-dhcp", "msg": "DHCPDISCOVER(br-iot) 02:AB:CD:00:00:03"},
        {"program": "dnsmasq-dhcp", "msg": "no address range available"},
        {"program": "dnsmasq", "msg": "12 10.10.50.7/5353 query[AAAA] api.vendor.example from 10.10.50.7"},
        {"program": "dnsmasq", "msg": "12 127.0.0.1/5353 query[A] test.example from 127.0.0.1"},
        {"program": "hostapd", "msg": "eth7: STA 02:00:00:00:00:04 IEEE 802.11: deauthenticated due to local deauth request"},
        {"program": "wlceventd", "msg": "eth7: Assoc_ind 02:AB:CD:00:00:03"},
        {"program": "vpnserver1", "msg": "peer up"},
    )
    assert [(e.kind, e.action, e.user, e.src_ip, e.client_ip, e.domain) for e in got] == [
        ("system", "dhcpack", "02:ab:cd:00:00:03", "10.10.50.7", None, None),
        ("system", "dhcpdiscover", "02:ab:cd:00:00:03", None, None, None),
        ("system", None, None, None, None, None),
        ("dns", None, None, None, "10.10.50.7", "api.vendor.example"),
        ("system", None, None, None, None, None),
        ("auth", "deauth", "02:00:00:00:00:04", None, None, None),
        ("system", None, None, None, None, None),
        ("auth", None, None, None, None, None),
    ]
    assert got[3].src_zone == "iot"


def test_timestamps(spark, profile):
    stamps = ["2026-06-01T03:14:15.999Z", "2026-06-01 03:14", "2026-06-01", "1780283655", "soon", None]
    got = parse(spark, profile, *[{"program": "x", "msg": f"m{i}", "timestamp": s} for i, s in enumerate(stamps)])
    assert [e.ts for e in got] == [datetime(2026, 6, 1, 3, 14, 15), datetime(2026, 6, 1, 3, 14), datetime(2026, 6, 1), datetime(2026, 6, 1, 3, 14, 15)]


def test_syslog_pages_land_once(spark, profile, tmp_path):
    folder = tmp_path / "device=8"
    folder.mkdir()
    logs = [{"timestamp": STAMP, "program": "CRON", "msg": f"m{i}", "seq": i + 1, "level": 6} for i in range(5)]
    for name in ("p1.json", "p2.json"):
        (folder / name).write_text(json.dumps({"total": 5, "logs": logs}))
    events = syslog.load_syslog(spark, str(tmp_path), profile).collect()
    assert len(events) == 5 and {e.device for e in events} == {"8"} and {e.severity for e in events} == {"info"}


def test_syslog_copies_go_before_lines_are_parsed(spark, profile, tmp_path):
    """Pages over several lines, with numbers as text; of copies the last one in ingest order stays."""
    folder = tmp_path / "device=8"
    folder.mkdir()
    line = {"timestamp": 1780283655.50, "program": "CRON", "msg": "m", "seq": 1, "level": 6}
    other = {"timestamp": "2026-06-01", "program": "CRON", "msg": "n", "id": 12345678901234567890, "level": 3}
    undated = {"timestamp": "soon", "program": "CRON", "msg": "x", "seq": 9, "level": 3}
    (folder / "p1.json").write_text(json.dumps({"total": 3, "logs": [line, other, undated]}, indent=1))
    (folder / "p2.json").write_text(json.dumps([{"total": 3, "logs": [line]}, {"total": 3, "logs": [undated]}], indent=1))
    (folder / "p3.json").write_text(json.dumps({"total": 3, "logs": [{**line, "level": 4}]}))
    (folder / "p4.json").write_text("")
    lines = syslog.read_syslog_landing(spark, str(tmp_path))
    assert {(r.timestamp, r.seq, r.level) for r in lines.collect()} == {
        ("1780283655.5", "1", "6"), ("1780283655.5", "1", "4"), ("2026-06-01", "12345678901234567890", "3"), ("soon", "9", "3")
    }
    assert syslog.last_copies(lines).count() == 2
    assert {(e.message, e.severity) for e in syslog.load_syslog(spark, str(tmp_path), profile).collect()} == {("m", "warning"), ("n", "err")}


def test_dns_pages(spark, profile, tmp_path):
    queries = [
        {"id": 1, "time": 1780283655.5, "domain": "Ads.Example.COM.", "type": "A", "status": "GRAVITY", "client": {"ip": "10.10.0.20", "name": "pc"}, "upstream": {"ip": "9.9.9.9", "name": None}},
        {"id": 2, "time": 1780283655, "domain": "x\u0001y.example", "type": "TXT", "status": "FORWARDED", "client": "10.10.50.4", "upstream": "1.1.1.1"},
        {"id": 3, "time": 1780283655, "domain": "a", "status": "IN_PROGRESS", "client": "10.10.50.4"},
        {"id": 4, "time": None, "domain": "a", "status": "CACHE", "client": "10.10.50.4"},
        {"id": 5, "time": "garbage", "domain": "a", "status": "CACHE", "client": "10.10.50.4"},
        {"id": 2, "time": 1780283656, "domain": "last.example", "type": "A", "status": "NXDOMAIN", "client": "10.10.50.4"},
    ]
    (tmp_path / "page.json").write_text(json.dumps({"recordsFiltered": 6, "queries": queries}))
    got = {e.domain: e for e in dnslog.load_dns(spark, str(tmp_path), profile).collect()}
    assert set(got) == {"ads.example.com", "last.example"}
    assert got["ads.example.com"].blocked and got["ads.example.com"].upstream == "9.9.9.9" and got["ads.example.com"].src_zone == "lan"
    assert not got["last.example"].blocked and got["last.example"].block_reason == "NXDOMAIN"


def record(**over):
    base = {
        "eventTime": "2026-06-01T03:00:00Z", "eventSource": "s3.amazonaws.com", "eventName": "GetObject", "awsRegion": "us-east-1",
        "sourceIPAddress": "203.0.113.5", "userAgent": "cli", "eventID": "e1", "readOnly": True, "recipientAccountId": "111111111111",
        "userIdentity": {"type": "IAMUser", "arn": "arn:aws:iam::111111111111:user/bob", "accountId": "111111111111", "principalId": "AID"},
        "requestParameters": {"bucketName": "b1", "name": "n1"},
    }
    return {**base, **over}


def test_audit_files_are_pruned_and_normalised(spark, profile, tmp_path):
    def deliver(account, day, stamp, records, org=""):
        folder = tmp_path / "AWSLogs" / org / account / "CloudTrail" / "us-east-1" / day
        folder.mkdir(parents=True, exist_ok=True)
        name = f"{account}_CloudTrail_us-east-1_{stamp}Z_x.json.gz"
        (folder / name).write_bytes(gzip.compress(json.dumps({"Records": records}).encode()))

    root = {"type": "Root", "accountId": "111111111111"}
    role = {"type": "AssumedRole", "arn": "arn:aws:sts::1:assumed-role/ci/x", "sessionContext": {"sessionIssuer": {"arn": "arn:aws:iam::1:role/ci"}, "attributes": {"mfaAuthenticated": "false"}}}
    deliver("111111111111", "2026/06/01", "20260601T0305", [
        record(), record(),
        record(eventID="e2", userIdentity=root, errorCode="AccessDenied", readOnly=False, requestParameters=None),
        record(eventID="e3", userIdentity=role, eventName="ConsoleLogin", eventSource="signin.amazonaws.com", responseElements={"ConsoleLogin": "Success"}, additionalEventData={"MFAUsed": "No"}),
        record(eventID="e4", userIdentity={"type": "AWSService"}),
        record(eventID="e5", eventTime="2026-06-01T09:00:00Z"),
        record(eventID="e6", sourceIPAddress="cloudformation.amazonaws.com", requestParameters={"instancesSet": {"items": [{"instanceId": "i-1"}]}, "names": ["a", 5, "b"]}),
    ])
    deliver("222222222222", "2026/06/01", "20260601T0305", [record(eventID="o1", recipientAccountId="222222222222")], org="o-abc")
    deliver("111111111111", "2026/06/01", "20260601T2000", [record(eventID="late")])
    deliver("111111111111", "2026/05/20", "20260520T0305", [record(eventID="old")])
    window = Window(datetime(2026, 6, 1, 2, tzinfo=UTC), datetime(2026, 6, 1, 4, tzinfo=UTC))
    got = {(e.user, e.program): e for e in cloudtrail.load_cloudtrail(spark, str(tmp_path), window, profile).collect()}
    bob = "arn:aws:iam::111111111111:user/bob"
    assert sorted(got) == sorted([(bob, "s3:GetObject"), ("arn:aws:iam::111111111111:root", "s3:GetObject"), ("arn:aws:iam::1:role/ci", "signin:ConsoleLogin")])
    denied = got[("arn:aws:iam::111111111111:root", "s3:GetObject")]
    assert (denied.action, denied.severity, denied.block_reason, denied.raw.targets, denied.raw.request) == ("denied", "write", "AccessDenied", [], None)
    login = got[("arn:aws:iam::1:role/ci", "signin:ConsoleLogin")]
    assert (login.kind, login.action, login.raw.mfa) == ("auth", "aws_login_ok", "No")
    all_events = cloudtrail.load_cloudtrail(spark, str(tmp_path), window, profile)
    assert all_events.count() == 5
    assert all_events.where("src_ip is null").head().raw.targets == ["a", "b", "i-1"]
    only = cloudtrail.load_cloudtrail(spark, str(tmp_path), window, profile, accounts=["222222222222"])
    assert [e.device for e in only.collect()] == ["222222222222/us-east-1"]
    records = cloudtrail.scan_cloudtrail(spark, str(tmp_path), window)
    assert cloudtrail.service_call_count(records).head().service_calls == 1
    assert cloudtrail.scan_cloudtrail(spark, str(tmp_path / "none"), window).count() == 0


def test_findings(spark, profile, tmp_path):
    finding = {
        "Id": "f1", "Type": "Recon:EC2/PortProbe", "Severity": 7.0, "Title": "Probe", "AccountId": "1", "Region": "eu-west-1", "UpdatedAt": "2026-06-01T03:00:00Z",
        "Resource": {"InstanceDetails": {"InstanceId": "i-1", "NetworkInterfaces": [{"PrivateIpAddress": "10.10.0.4"}]}},
        "Service": {"Count": 2, "Action": {"PortProbeAction": {"PortProbeDetails": [{"RemoteIpDetails": {"IpAddressV4": "203.0.113.7"}, "LocalPortDetails": {"Port": 22}}]}}},
    }
    (tmp_path / "f.json").write_text(json.dumps(finding) + "\n" + json.dumps({**finding, "UpdatedAt": None}))
    rows = guardduty.normalize_guardduty(guardduty.read_findings(spark, str(tmp_path)), profile).collect()
    assert [(r.kind, r.severity, r.src_ip, r.dst_ip, r.dst_port, r.device, r.raw.score) for r in rows] == [("ids", "HIGH", "203.0.113.7", "10.10.0.4", 22, "1/eu-west-1", 7.0)]


def test_indicator_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "﻿Indicator,Type,Tier,Campaign,notes,alert_until\n"
        "203.0.113[.]7,ip,T2,camp,careful,2099-01-01\n198.51.100.0/24,,t1,,,\nhxxps://Bad.Example[.]com/x,domain,,,,\n"
        "203.0.113.9,ip,T3,,,2020-01-01\nabc123,sha256,T1,,,\nx.exe,filename,T1,,,\n2001:db8::/20,cidr,T1,,,\n"
    )
    (tmp_path / "b.txt").write_text("# comment\n*.evil.example # suffix\n203.0.113.7\n10.0.0.0/4\n")
    found, summary = lists.load_lists(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.txt")], date(2026, 6, 1))
    rows = {(r.kind, r.value): (r.severity, r.tier, r.origin) for r in found.collect()}
    assert rows == {
        ("ip", "203.0.113.7"): (3, "T2", "a.csv"), ("cidr", "198.51.100.0/24"): (4, "T1", "a.csv"),
        ("domain", "bad.example.com"): (1, "", "a.csv"), ("domain_suffix", "evil.example"): (1, "", "b.txt"),
    }
    assert {(r.status, r.detail): r.n for r in summary.collect()} == {
        ("usable", ""): 5, ("expired", ""): 1, ("skipped", "sha256"): 1, ("skipped", "filename"): 1, ("invalid", ""): 2
    }
    values = spark.createDataFrame([("203.0.113.7",), ("198.51.100.77",), ("8.8.8.8",), ("junk",)], "value string")
    assert {(r.value, r.kind) for r in match.match_ips(values, found).collect()} == {("203.0.113.7", "ip"), ("198.51.100.77", "cidr")}
    names = spark.createDataFrame([("A.Bad.example.com.",), ("notbad.example.com",), ("x.evil.example",), ("evil.example",)], "value string")
    assert {r.value for r in match.match_domains(names, found).collect()} == {"A.Bad.example.com.", "x.evil.example", "evil.example"}


@pytest.mark.parametrize("bad", [
    {"zones": [{"cidrs": ["10.0.0.0/8"]}]}, {"zones": [{"name": "x", "cidrs": ["10.0.0.0/99"]}]}, {"cloud_accounts": [{}]},
    {"cloud_accounts": [{"account_id": "1", "principals": [{}]}]},
    {"cloud_accounts": [{"account_id": "1", "watched_resources": [{"match": "a", "severity": "INFO"}]}]}, [],
])
def test_bad_profiles_are_refused(bad):
    with pytest.raises(ProfileError):
        Profile.parse(bad)


def test_profile_dimensions(spark, profile, tmp_path):
    dims = profile.dimension_frames(spark)
    assert dims["zones"].count() == 3 and dims["policy_lists"].where("list = 'attack_port'").count() == 4
    (tmp_path / "p.yml").write_text("site: {name: home}\nzones: [{name: lan, cidrs: [10.0.0.0/24]}]\n")
    assert Profile.load(tmp_path / "p.yml").zones[0].name == "lan" and Profile.load(None).zones == ()


def test_window():
    window = Window(datetime(2026, 6, 1, tzinfo=UTC), datetime(2026, 6, 3, tzinfo=UTC))
    assert window.clamp(24).start == datetime(2026, 6, 2, tzinfo=UTC) and window.clamp(None) is window
    with pytest.raises(ValueError):
        Window(window.end, window.start)
    with pytest.raises(ValueError):
        Window(datetime(2026, 6, 1), datetime(2026, 6, 3))


def test_duplicates(spark):
    from sentrylake.sources.common import dedup_events

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "dedup_key string, pos int, v string")
    keep = lambda k: {r.dedup_key: r.v for r in dedup_events(rows, ["pos"], keep=k).collect()}
    assert keep("last") == {"a": "y", "b": "z"} and keep("first") == {"a": "x", "b": "z"}


def test_audit_files_outside_the_filters_are_never_opened(spark, tmp_path):
    """Files outside hold no gzip, so opening one fails the job."""
    def put(account, region, day, name, body=None):
        folder = tmp_path / "AWSLogs" / account / "CloudTrail" / region / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"not gzip" if body is None else gzip.compress(json.dumps({"Records": [{"eventID": body}]}).encode()))

    window = Window(datetime(2026, 5, 31, 12, tzinfo=timezone.utc), datetime(2026, 6, 1, 12, tzinfo=timezone.utc))
    put("1", "r", "2026/05/31", "a_20260531T1105Z_x.json.gz", "slack before")
    put("1", "r", "2026/06/01", "a_20260601T1255Z_x.json.gz", "slack after")
    put("o-1/2", "r", "2026/06/01", "unnamed.json.gz", "no time")
    put("1", "r", "2026/05/31", "a_20260531T1055Z_x.json.gz")
    put("1", "r", "2026/06/01", "a_20260601T1305Z_x.json.gz")
    put("1", "r", "2026/06/01", "a_20260601T0305Z_x.txt")
    put("1", "r", "2026/06/02", "unnamed.json.gz")
    put("1", "r", "2025/05/31", "a_20260601T0305Z_x.json.gz")
    put("1", "r", "2026/13/99", "unnamed.json.gz")
    put("3", "r", "2026/06/01", "a_20260601T0305Z_x.json.gz")
    put("1", "other", "2026/06/01", "a_20260601T0305Z_x.json.gz")
    got = cloudtrail.scan_cloudtrail(spark, str(tmp_path), window, accounts=["1", "2"], regions=["r"])
    assert {r.eventID for r in got.collect()} == {"slack before", "slack after", "no time"}
    put("1", "r", "2026/06/01", "a_20260601T0305Z_y.json.gz", "x" * 10)
    assert got.count() == 4 and cloudtrail.scan_cloudtrail(spark, str(tmp_path), window, accounts=["1"], regions=["r"]).count() == 3
    with pytest.raises(Exception, match="gzip"):
        cloudtrail.scan_cloudtrail(spark, str(tmp_path), window).collect()
