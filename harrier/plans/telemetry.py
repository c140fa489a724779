"""Queries over observations of all kinds, made from the events table: one line of JSON for each event, read back in one pass."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.operators import rules
from harrier.sources import observations

from .registry import query

ID = "{id}"  # stands for the event's number
N = 10_000_001  # a number that is replaced by it, for fields that aren't texts


def _path(p: str) -> dict:
    return {"s": p}


# kind -> variants of (fields, what the hunting table holds, what the enabled rules say as (rule, title))
VARIANTS: dict[str, list[tuple[dict, dict, list]]] = {
    "process": [
        ({"pid": N, "ppid": 1, "comm": "sh", "exe": _path("/bin/sh"), "exe_memfd": True, "cmdline": [_path("sh"), _path("-p"), _path("c{id}")], "uids": [1000, 0, 0, 0], "tty": 1},
         {"process_name": "sh", "process_id": ID, "user": "1000", "path": "/bin/sh", "args": "-p c{id}", "cmdline": "sh -p c{id}", "severity": "high", "exe_memfd": "1", "message": "process pid={id} comm=sh exe=/bin/sh args=-p c{id}"},
         [("RM-PROC-0005", "Process 'sh' (pid {id}) executing from memfd/anon_inode"), ("RM-PROC-0015", "Process 'sh' running as euid 0 with ruid 1000 (active privilege elevation)"),
          ("RM-PROC-0017", "Privileged shell 'sh' (pid {id}) with -p — likely SUID shell abuse")]),
        ({"pid": N, "comm": "x{id}", "exe": _path("/tmp/x{id}"), "cmdline": [_path("/tmp/x{id} --run")], "uids": [5, 5, 5, 5], "cwd": _path("/dev/shm"), "environ_flags": ["LD_PRELOAD"]},
         {"process_name": "x{id}", "process_id": ID, "user": "5", "path": "/tmp/x{id}", "args": "--run", "cmdline": "/tmp/x{id} --run", "message": "process pid={id} comm=x{id} exe=/tmp/x{id} args=--run"},
         [("RM-PROC-0008", "Process 'x{id}' executing from /tmp/x{id}"), ("RM-PROC-0009", "Process 'x{id}' (pid {id}) has LD_PRELOAD/LD_AUDIT in environment"), ("RM-PROC-0013", "Process 'x{id}' (pid {id}) cwd /dev/shm")]),
        ({"pid": N, "comm": "kworker"}, {"process_name": "kworker", "process_id": ID, "user": "0", "message": "process pid={id} comm=kworker exe=—"}, []),
    ],
    "hidden_process": [
        ({"pid": N, "passes_confirmed": 2, "uid": 7, "exe": "/h", "sources_absent": ["proc", "ps"]}, {"process_id": ID, "user": "7", "path": "/h", "severity": "critical", "message": 'hidden process pid={id} sources_absent=["proc", "ps"]'}, [("RM-PROC-0001", "Hidden process pid {id} (kernel-present, /proc-absent)")]),
        ({"pid": N, "passes_confirmed": 1, "comm": "q"}, {"process_name": "q", "process_id": ID, "severity": "critical", "message": "hidden process pid={id} sources_absent=[]"}, [("RM-PROC-0002", "Unconfirmed hidden process pid {id} (needs review)")]),
    ],
    "socket": [
        ({"protocol": "tcp", "state": "LISTEN", "local_ip": "0.0.0.0", "local_port": N, "remote_ip": "0.0.0.0", "remote_port": 0, "uid": 3, "owner_unresolved": True}, {"user": "3", "src_ip": "0.0.0.0:{id}", "dest_ip": "0.0.0.0:0", "message": "tcp LISTEN 0.0.0.0:{id} → 0.0.0.0:0 (pid=None)"}, [("RM-NET-0002", "Listener 0.0.0.0:{id} has no visible owner")]),
        ({"protocol": "RAW", "state": "ESTAB", "local_ip": "::1", "local_port": 1, "remote_ip": "::2", "remote_port": 2, "uid": 0, "owning_pid": N, "inode": "77"}, {"process_id": ID, "user": "0", "src_ip": "::1:1", "dest_ip": "::2:2", "message": "RAW ESTAB ::1:1 → ::2:2 (pid=Some({id}))"}, [("RM-NET-0005", "Sniffer-class socket (RAW) uid 0 inode 77")]),
    ],
    "hidden_socket": [({"local_port": N, "protocol": "udp", "sources_absent": ["net"]}, {"src_ip": "*:{id}", "severity": "high", "message": 'hidden socket udp:{id} absent=["net"]'}, [("RM-NET-0001", "Hidden udp socket on port {id}")])],
    "module": [
        ({"name": "reptile{id}", "size": N, "in_sysfs": True, "in_proc_modules": True}, {"process_name": "reptile{id}", "message": "module reptile{id} size=Some({id})"}, [("RM-KERN-0004", "Known rootkit module name 'reptile{id}'")]),
        ({"name": "m{id}", "taint_flags": "OE"}, {"process_name": "m{id}", "message": "module m{id} size=None"}, [("RM-KERN-0002", "Out-of-tree/unsigned module 'm{id}' (taint OE)")]),
    ],
    "hidden_module": [({"name": "m{id}", "in_sysfs": True, "in_proc_modules": False}, {"process_name": "m{id}", "severity": "critical", "message": "module m{id} size=None"}, [("RM-KERN-0001", "Hidden or inconsistent module 'm{id}' (sysfs=true proc=false)")])],
    "bpf_prog": [
        ({"id": N, "prog_type": "kprobe", "orphan": True}, {"severity": "high", "message": "bpf prog id={id} type=kprobe"}, [("RM-KERN-0006", "Orphan eBPF program id {id} (kprobe)")]),
        ({"id": N, "prog_type": "xdp", "name": "n", "orphan": False}, {"process_name": "n", "message": "bpf prog id={id} type=xdp"}, []),
    ],
    "file_meta": [
        ({"path": _path("/tmp/{id}/nmap"), "mode": 0o4755, "uid": N, "setuid": True, "size": "5"}, {"path": "/tmp/{id}/nmap", "user": ID, "message": "file_meta /tmp/{id}/nmap"}, [("RM-FILE-0006", "Setuid binary in suspicious path /tmp/{id}/nmap"), ("RM-FILE-0015", "GTFOBins setuid binary /tmp/{id}/nmap")]),
        ({"path": _path("/dev/d{id}"), "uid": 0, "size": "9000", "immutable": True}, {"path": "/dev/d{id}", "user": "0", "message": "file_meta /dev/d{id}"}, [("RM-FILE-0010", "Large regular file under /dev/d{id}")]),
        ({"path": _path("/data/.icscap/{id}"), "uid": 1}, {"path": "/data/.icscap/{id}", "user": "1", "message": "file_meta /data/.icscap/{id}"}, [("RM-ICS-0002", "Hidden ICS capture toolkit path /data/.icscap/{id}")]),
    ],
    "file_entropy": [({"path": _path("/var/tmp/{id}"), "entropy": 7.5, "window_max": 6.0, "is_elf": True, "sha256": "s{id}"}, {"path": "/var/tmp/{id}", "file_hash": "s{id}", "severity": "high", "message": "entropy=7.50 /var/tmp/{id}"}, [("RM-FILE-0001", "High-entropy ELF at /var/tmp/{id} (entropy 7.5)"), ("RM-FILE-0009", "ELF in staging path /var/tmp/{id}")])],
    "elf_info": [({"path": _path("/e{id}"), "is_static": False, "interp": "/opt/ld.so", "has_rwx_segment": True, "packer_hints": []}, {"path": "/e{id}", "message": "elf /e{id} static=false"}, [("RM-FILE-0002", "Packed or anomalous ELF at /e{id}"), ("RM-FILE-0013", "ELF /e{id} uses interpreter /opt/ld.so")])],
    "preload": [({"path": _path("/etc/ld.so.conf.d/{id}"), "present": True, "entries": []}, {"path": "/etc/ld.so.conf.d/{id}", "severity": "high", "message": "preload /etc/ld.so.conf.d/{id}"}, [("RM-PERSIST-0001", "ld.so.preload present at /etc/ld.so.conf.d/{id}"), ("RM-PERSIST-0002", "Suspicious ld.so config at /etc/ld.so.conf.d/{id}")])],
    "scheduled_task": [({"kind": "cron", "path": _path("/etc/cron.d/{id}"), "user": "u{id}", "command": "curl x"}, {"path": "/etc/cron.d/{id}", "user": "u{id}", "message": "scheduled cron /etc/cron.d/{id}"}, [("RM-PERSIST-0003", "Suspicious scheduled task in /etc/cron.d/{id}: curl x")])],
    "service": [({"name": "s{id}", "path": _path("/etc/profile.d/{id}"), "exec_start": "/tmp/a LD_PRELOAD", "unit_type": "service"}, {"process_name": "s{id}", "path": "/etc/profile.d/{id}", "message": "service s{id} service"}, [("RM-PERSIST-0005", "systemd unit s{id} ExecStart uses staging path"), ("RM-PERSIST-0009", "Suspicious shell startup hook in /etc/profile.d/{id}")])],
    "account": [
        ({"username": "a{id}", "uid": 0, "gid": 0, "shell": "/bin/sh"}, {"user": "a{id}", "path": "/bin/sh", "message": "account uid=0 a{id}"}, [("RM-USER-0001", "UID 0 account 'a{id}' other than root")]),
        ({"username": "a{id}", "uid": 33, "shell": "/bin/sh"}, {"user": "a{id}", "path": "/bin/sh", "message": "account uid=33 a{id}"}, [("RM-USER-0003", "Service account 'a{id}' has login shell /bin/sh")]),
    ],
    "shadow_entry": [
        ({"username": "a{id}", "algorithm": "md5crypt", "locked": False, "empty_password": False}, {"user": "a{id}", "severity": "medium", "message": "shadow a{id}"}, [("RM-CRED-0001", "Weak hash algorithm 'md5crypt' for account 'a{id}'"), ("RM-CRED-0003", "Active password hash on account 'a{id}' (review lock policy)")]),
        ({"username": "a{id}", "empty_password": True}, {"user": "a{id}", "severity": "medium", "message": "shadow a{id}"}, [("RM-USER-0002", "Passwordless login enabled for account 'a{id}'")]),
    ],
    "sudo_rule": [({"path": _path("/s{id}"), "line": "a SETENV {id}", "nopasswd": True, "all_commands": True}, {"path": "/s{id}", "message": "sudo a SETENV {id}"}, [("RM-USER-0005", "Passwordless sudo for all commands in /s{id}"), ("RM-USER-0006", "Unsafe sudoers line in /s{id}: a SETENV {id}")])],
    "authorized_key": [({"path": _path("/k{id}"), "username": "u", "key_type": "ssh-rsa", "fingerprint": "f{id}", "options": ['command="/bin/sh"'], "bits": 1024}, {"path": "/k{id}", "user": "u", "process_name": "sshd", "severity": "medium", "message": "authorized_key u f{id}"}, [("RM-CRED-0005", "Weak SSH key ssh-rsa (1024 bits) for u"), ("RM-USER-0009", "Suspicious forced command in /k{id} for u")])],
    "ssh_host_key": [({"path": _path("/k{id}"), "key_type": "ed25519", "fingerprint": "f{id}", "changed": True}, {"path": "/k{id}", "message": "ssh_host_key ed25519"}, [("RM-POL-0001", "SSH host key changed (ed25519 f{id})")])],
    "dir_anomaly": [({"path": _path("/d{id}"), "anomaly": "nlink_mismatch", "detail": "d{id}"}, {"path": "/d{id}", "severity": "high", "message": "dir_anomaly nlink_mismatch: d{id}"}, [("RM-DIR-0001", "Hidden directory suspected at /d{id}")]),
                    ({"path": _path("/d{id}"), "anomaly": "unlisted_open_file", "detail": "x"}, {"path": "/d{id}", "severity": "high", "message": "dir_anomaly unlisted_open_file: x"}, [("RM-DIR-0005", "Hidden open file at /d{id}")])],
    "timestomp": [({"path": _path("/t{id}"), "btime": 9, "mtime": 5}, {"path": "/t{id}", "severity": "high", "message": "timestomp /t{id}"}, [("RM-FILE-0012", "Timestomp suspected on /t{id}")])],
    "mount": [({"device": "dev{id}", "mountpoint": _path("/m{id}"), "fstype": "ext4"}, {"path": "/m{id}", "message": "mount dev{id} /m{id} ext4"}, [])],
    "log_integrity": [({"path": _path("/var/log/wtmp{id}"), "issue": "zeroed", "detail": "d"}, {"path": "/var/log/wtmp{id}", "severity": "high", "message": "log_integrity zeroed: d"}, [("RM-LOG-0001", "Login record integrity issue: /var/log/wtmp{id} (zeroed)")])],
    "utmp_session": [({"user": "u{id}", "line": "pts/0", "host": "h{id}", "pid": N}, {"user": "u{id}", "process_id": ID, "src_ip": "h{id}", "message": "session u{id}@pts/0 pid={id}"}, [])],
    "integrity_mismatch": [({"path": _path("/b{id}"), "expected_hash": "x", "actual_hash": "y{id}"}, {"path": "/b{id}", "file_hash": "y{id}", "severity": "critical", "message": "integrity mismatch /b{id}"}, [("RM-DRIFT-0001", "Critical file drift / integrity mismatch for /b{id}"), ("RM-FILE-0004", "Integrity mismatch for /b{id}")])],
    "ioc_hit": [({"path": _path("/i{id}"), "ioc_kind": "path", "ioc_value": "v{id}", "severity": "High"}, {"path": "/i{id}", "severity": "high", "message": "ioc path=v{id}"}, [("RM-FILE-0008", "Known rootkit/IOC path /i{id} (v{id})")])],
    "container_info": [({"in_container": True, "runtime": "r{id}", "privileged": False}, {"message": 'container in=true runtime=Some("r{id}") privileged=false'}, [])],
    "recon": [({"category": "c{id}", "data": {"k": "v"}}, {"message": "recon c{id}"}, [])],
    "policy": [({"code": "RM-POL-0021", "detail": "d{id}", "severity": "Medium"}, {"check_id": "RM-POL-0021", "severity": "medium", "message": "policy RM-POL-0021: d{id}"}, [("RM-POL-0021", "Host could not be inspected with full-fidelity probe: d{id}")])],
}

PLACES = [(k, v) for k, variants in VARIANTS.items() for v in range(len(variants))]
COLUMNS = ("message", "check_id", "process_name", "process_id", "user", "path", "args", "cmdline", "src_ip", "dest_ip", "file_hash", "severity", "exe_memfd")
DEFAULTS = {"severity": "info", "process_id": "0", "exe_memfd": "0"}


def observed(events: DataFrame) -> DataFrame:
    """event_id, ts, user_id, line: event n is an observation of the n-th kind and variant, round and round."""
    texts = [json.dumps({"t": k} | VARIANTS[k][v][0]).replace(str(N), ID) for k, v in PLACES]
    template = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % len(PLACES) + 1).cast("int"))
    return events.select("event_id", "ts", "user_id", F.replace(template, F.lit(ID), F.col("event_id").cast("string")).alias("line"))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EVENTS_SQL = ", ".join(f"({n}, {_sql(k)}, {', '.join(_sql(VARIANTS[k][v][1].get(c, DEFAULTS.get(c, ''))) for c in COLUMNS)})" for n, (k, v) in enumerate(PLACES))
_FOUND_SQL = ", ".join(f"({n}, {_sql(check)}, {_sql(title)})" for n, (k, v) in enumerate(PLACES) for check, title in VARIANTS[k][v][2])
_FILLED = {c: f"replace({c}, '{ID}', CAST(event_id AS VARCHAR))" for c in COLUMNS}


@query(f"""WITH w(n, kind, {", ".join(COLUMNS)}) AS (VALUES {_EVENTS_SQL})
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'h' || user_id AS host_id, 'host ' || user_id AS host_name, CAST(event_id // 100 AS VARCHAR) AS scan_id, kind AS collector, 'probe' AS source_type, 'scan' AS source, 'linux' AS platform, kind, kind AS data_type,
{", ".join(f"CAST({_FILLED[c]} AS BIGINT) AS {c}" if c in ("process_id", "exe_memfd") else f"{_FILLED[c]} AS {c}" for c in COLUMNS)}, true AS whole FROM events JOIN w ON event_id % {len(PLACES)} = n""")
def observations_as_events(t):
    rows = observations.parsed(observed(t("events")), "event_id", "ts", "user_id")
    event = F.col("event_id")
    found = observations.observation_events(rows, F.col("ts"), F.concat(F.lit("h"), "user_id"), F.concat(F.lit("host "), "user_id"), F.floor(event / 100), F.col("kind"), keep=("event_id",))
    whole = F.get_json_object("ext", "$.t") == F.col("kind")
    return found.withColumns({"at": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "whole": whole, "exe_memfd": F.col("exe_memfd").cast("long")}).drop("timestamp", "ext")


@query(f"WITH w(n, check_id, title) AS (VALUES {_FOUND_SQL}) SELECT event_id, check_id, replace(title, '{ID}', CAST(event_id AS VARCHAR)) AS title FROM events JOIN w ON event_id % {len(PLACES)} = n")
def rules_of_all_kinds(t):
    rows = observations.parsed(observed(t("events")), "event_id")
    return rules.findings(rows, keep=("event_id",)).select("event_id", "check_id", "title")
