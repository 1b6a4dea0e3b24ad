"""Rule tables over texts: script rules with evidence, indicator counts, build files.

A rule is a title, a category, a severity and patterns; it hits a text where enough of its patterns match.  All
rules are evaluated in one projection per text.  Rule sets are parameters and carry a version into the output.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import first_by


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    title: str
    patterns: tuple[str, ...]
    least: int = 1
    #: Lower-case texts of which every match of a pattern holds one; the patterns aren't tested on a text without any.
    needs: tuple[str, ...] = ()


RULES_VERSION = "1.0.0"
#: The install-script rules; (?i) marks patterns that ignore case.
SCRIPT_RULES = (
    Rule("remote-shell-pipe", "remoteCodeExecution", "critical", "Remote payload piped into a shell", (r"(?i)\b(?:curl|wget)\b[^\n|]{0,240}\|\s*(?:sudo\s+)?(?:ba|z|d|a|c)?sh\b", r"(?i)\b(?:curl|wget)\b[^\n|]{0,240}\|\s*(?:node|python[23]?|perl|ruby)\b", r"(?i)\biwr\b[^\n|]{0,240}\|\s*iex\b", r"(?i)Invoke-WebRequest[^\n]{0,240}\|\s*Invoke-Expression"), needs=("curl", "wget", "iwr", "invoke-webrequest")),
    Rule("remote-fetch-eval", "remoteCodeExecution", "critical", "Remote code fetched and evaluated", (r"(?i)eval\s*\(\s*(?:await\s+)?(?:fetch|require\s*\(\s*['\"]https?:)", r"(?i)new\s+Function\s*\([^)]{0,120}(?:fetch|https?:\/\/|atob)", r"(?i)exec\s*\(\s*(?:await\s+)?(?:requests?\.(?:get|post)|urllib|urlopen)", r"(?i)(?:vm\.runInNewContext|vm\.runInThisContext)\s*\([^)]{0,80}(?:fetch|http)"), needs=("eval", "function", "exec", "vm.runin")),
    Rule("shell-exec-in-install", "scriptInjection", "high", "Shell command execution", (r"(?i)child_process['\"]?\s*\)?\s*\.\s*(?:exec|execSync|spawn|spawnSync|execFile)\s*\(", r"(?i)\brequire\s*\(\s*['\"]child_process['\"]\s*\)", r"(?i)\bos\.system\s*\(", r"(?i)\bsubprocess\.(?:run|call|Popen|check_output|check_call)\s*\(", r"(?i)\bos\.popen\s*\("), needs=("child_process", "os.system", "subprocess.", "os.popen")),
    Rule("dynamic-code-eval", "scriptInjection", "medium", "Dynamic code evaluation", (r"(?i)\beval\s*\(", r"(?i)new\s+Function\s*\(", r"\b(?:exec|compile)\s*\(\s*(?:[\"'`]|[A-Za-z_])", r"(?i)\bGLOBAL\b|\bglobalThis\s*\["), needs=("eval", "function", "exec", "compile", "global")),
    Rule("env-secret-harvest", "environmentTheft", "high", "Sensitive environment variable access", (r"\b(?:NPM_TOKEN|NPM_AUTH_TOKEN|NODE_AUTH_TOKEN)\b", r"\bAWS_(?:SECRET_ACCESS_KEY|ACCESS_KEY_ID|SESSION_TOKEN)\b", r"\b(?:GITHUB_TOKEN|GH_TOKEN|GITLAB_TOKEN|CI_JOB_TOKEN)\b", r"\b(?:STRIPE_SECRET_KEY|TWILIO_AUTH_TOKEN|SLACK_TOKEN|DIGITALOCEAN_TOKEN)\b"), needs=("_token", "aws_", "stripe_secret_key")),
    Rule("env-enumeration", "environmentTheft", "high", "Bulk environment variable enumeration", (r"(?i)JSON\.stringify\s*\(\s*process\.env\b", r"(?i)Object\.(?:keys|entries|values|assign)\s*\(\s*\{?\s*\.{0,3}\s*process\.env\b", r"(?i)\{\s*\.\.\.\s*process\.env\s*\}", r"(?i)\bdict\s*\(\s*os\.environ\s*\)|\bos\.environ\.copy\s*\(\)|json\.dumps\s*\(\s*dict\s*\(\s*os\.environ"), needs=("process.env", "os.environ")),
    Rule("credential-file-access", "environmentTheft", "high", "Credential file access", (r"\.npmrc\b|\.pypirc\b", r"(?i)\.ssh\/(?:id_(?:rsa|ed25519|ecdsa)|authorized_keys)", r"(?i)\.aws\/credentials|\.config\/gcloud|\.kube\/config", r"(?i)(?:wallet\.dat|keystore|\.ethereum|\.electrum|Local Storage\/leveldb|\.config\/solana)"), needs=(".npmrc", ".pypirc", ".ssh/", ".aws/credentials", ".config/gcloud", ".kube/config", "wallet.dat", "keystore", ".ethereum", ".electrum", "local storage/leveldb", ".config/solana")),
    Rule("exfil-endpoint", "environmentTheft", "high", "Exfiltration endpoint", (r"(?i)discord(?:app)?\.com\/api\/webhooks", r"(?i)hooks\.slack\.com|api\.telegram\.org\/bot", r"(?i)(?:pastebin\.com|paste\.ee|pastes?\.io|transfer\.sh|0x0\.st)", r"(?i)\b[a-z0-9-]+\.(?:ngrok\.(?:io|app)|burpcollaborator\.net|interactsh\.com|oast\.(?:fun|live|site|pro))\b"), needs=("discord", "hooks.slack.com", "api.telegram.org/bot", "paste", "transfer.sh", "0x0.st", ".ngrok.", ".burpcollaborator.net", ".interactsh.com", ".oast.")),
    Rule("filesystem-wiper", "wiper", "critical", "Destructive filesystem operation", (r"(?i)\brm\s+-[rRfd]{1,3}[a-zA-Z]*\s+(?:--no-preserve-root\s+)?(?:\/(?:\s|$)|~|\$HOME|\/\*|\/root|\/home)", r"(?i)fs\.(?:rm|rmdir|rmSync)\s*\([^)]{0,160}recursive\s*:\s*true", r"(?i)shutil\.rmtree\s*\(\s*(?:os\.path\.expanduser\(['\"]~|['\"]\/)(?:[^)]*)", r"(?i)\b(?:del|rd)\s+\/[sqf]\b|format\s+[a-z]:|mkfs\.|dd\s+if=\/dev\/(?:zero|random|urandom)\s+of=\/"), needs=("-r", "-f", "-d", "fs.rm", "shutil.rmtree", "/s", "/q", "/f", "format", "mkfs.", "if=/dev/")),
    Rule("reverse-shell", "reverseShell", "critical", "Reverse shell", (r"(?i)(?:ba|z|c)?sh\s+-i\s+(?:>|&)?[^\n]{0,40}\/dev\/tcp\/", r"(?i)\bnc(?:at)?\b[^\n]{0,80}(?:-e|--exec|-c)\b[^\n]{0,40}(?:ba|z|c)?sh", r"(?i)socket\.socket\([^)]*\)[^\n]{0,400}(?:dup2|os\.dup2|subprocess)", r"(?i)net\.(?:connect|createConnection)\s*\([^)]{0,120}\)[^\n]{0,200}child_process"), needs=("/dev/tcp/", "-e", "-c", "socket.socket(", "net.connect", "net.createconnection")),
    Rule("obfuscated-blob", "obfuscation", "medium", "Obfuscated or encoded payload", (r"(?i)Buffer\.from\s*\(\s*['\"][A-Za-z0-9+/]{120,}={0,2}['\"]\s*,\s*['\"]base64['\"]", r"(?i)\batob\s*\(\s*['\"][A-Za-z0-9+/]{120,}", r"(?i)(?:String\.fromCharCode\s*\(\s*\d[\d,\s]{60,})", r"(?i)(?:\\x[0-9a-f]{2}){24,}|(?:\\u[0-9a-f]{4}){16,}"), needs=("buffer.from", "atob", "string.fromcharcode", "\\x", "\\u")),
    Rule("obfuscated-base64-exec", "remoteCodeExecution", "high", "Encoded payload decoded and executed", (r"(?i)(?:eval|exec|Function|child_process)[^\n]{0,80}(?:atob|Buffer\.from|base64\.b64decode)", r"(?i)base64\.b64decode\s*\([^)]{0,80}\)[^\n]{0,40}(?:exec|eval|compile)", r"(?i)(?:atob|Buffer\.from)[^\n]{0,80}(?:eval|new\s+Function|child_process)"), needs=("atob", "buffer.from", "base64.b64decode")),
    Rule("crypto-miner", "remoteCodeExecution", "high", "Cryptocurrency miner", (r"(?i)stratum\+tcp:\/\/", r"(?i)\bxmrig\b|cryptonight|\bminerd\b", r"(?i)pool\.(?:minexmr|supportxmr|nanopool)\."), needs=("stratum+tcp://", "xmrig", "cryptonight", "minerd", "pool.")),
    Rule("process-persistence", "scriptInjection", "high", "Persistence mechanism", (r"(?i)\bcrontab\s+-|\/etc\/cron\.|\/etc\/systemd\/system\/", r"(?i)>\>\s*~?\/?\.[bashrc|zshrc|bash_profile|profile]\b", r"\bLaunchAgents\b|\bLaunchDaemons\b", r"(?i)reg\s+add\b[^\n]{0,80}\\Run\b"), needs=("crontab", "/etc/cron.", "/etc/systemd/system/", ">>", "launchagents", "launchdaemons", "\\run")),
)


def rule_hits(sources: DataFrame, text: str, keys: Sequence[str], rules: Sequence[Rule] = SCRIPT_RULES, version: str = RULES_VERSION, evidence: bool = True) -> DataFrame:
    """A row per text and rule that hits: rule, category, severity, title, matched patterns and redacted evidence.

    Evidence is the first line that one of the rule's patterns matches.
    """
    t = F.col(text)

    def result(r: Rule, low: Column) -> Column:
        matched = F.lit(0)
        for p in r.patterns:
            matched = matched + t.rlike(p).cast("int")
        if r.needs:
            some = F.contains(low, F.lit(r.needs[0]))
            for w in r.needs[1:]:
                some = some | F.contains(low, F.lit(w))
            # a null text stays null
            matched = F.when(~some, 0).otherwise(matched)
        return F.struct(F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), matched.alias("matched"), F.lit(r.least).alias("least"))

    # the outer explode keeps the optimiser from testing every pattern a second time in a filter below it
    # a lambda's argument is worked out once: the text in lower case
    each = F.get(F.transform(F.array(F.lower(t)), lambda low: F.array(*[result(r, low) for r in rules])), F.lit(0))
    found = F.filter(each, lambda x: x["matched"] >= x["least"])
    kept = [*keys, text] if evidence else list(keys)
    out = sources.select(*kept, F.explode_outer(found).alias("h")).filter("h is not null").select(*kept, "h.rule", "h.category", "h.severity", "h.title", "h.matched")
    if evidence:
        line = None
        for r in rules:
            own = F.get(F.filter(F.split(t, "\n"), _any_of(r.patterns)), F.lit(0))
            line = F.when(F.col("rule") == r.id, own) if line is None else line.when(F.col("rule") == r.id, own)
        out = out.withColumn("evidence", S.redact(line))
    return out.drop(text).withColumn("rules_version", F.lit(version))


def _any_of(patterns: Sequence[str]):
    def test(line: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | line.rlike(p)
        return out

    return test


def merge_findings(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by category, key and title; the first table's finding wins."""
    both = first.withColumn("__from", F.lit(0)).unionByName(second.withColumn("__from", F.lit(1)))
    return first_by(both, [*keys, "category", "title"], "__from", "severity").drop("__from")


def demote_trusted(findings: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """Low and medium install-hook findings of trusted packages become info."""
    flag = trusted.select(key, F.lit(True).alias("__trusted")).distinct()
    out = findings.join(flag, key, "left")
    down = F.col("__trusted") & (F.col("category") == "installHook") & F.col("severity").isin("low", "medium")
    return out.withColumn("severity", F.when(down, "info").otherwise(F.col("severity"))).drop("__trusted")


def threat_summary(findings: DataFrame, key: str) -> DataFrame:
    """Per key and category: detected, and the number of distinct details, eight at most."""
    return findings.groupBy(key, "category").agg(F.lit(True).alias("detected"), F.least(F.lit(8), F.count_distinct("title")).cast("int").alias("n_details"))


#: Indicators in string literals: where data goes, control servers, wallets, tokens, staging.
LITERAL_RULES = {
    "exfil_discord_webhook": r"(?i)discord(?:app)?\.com/api/webhooks/\d+/[A-Za-z0-9_-]+",
    "exfil_slack_webhook": r"(?i)hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+",
    "exfil_telegram_bot": r"(?i)api\.telegram\.org/bot[0-9]+:[A-Za-z0-9_-]+/sendMessage",
    "exfil_pastebin": r"(?i)(?:pastebin\.com|hastebin\.com|paste\.ee|termbin\.com)/(?:raw/)?[A-Za-z0-9]+",
    "exfil_requestbin": r"(?i)(?:webhook\.site|requestbin\.com|pipedream\.net|beeceptor\.com)/[a-z0-9-]+",
    "c2_stratum_mining": r"(?i)stratum\+(?:tcp|ssl|tls)://",
    "c2_irc_privmsg": r"PRIVMSG\s+#[a-zA-Z0-9_-]+\s+:",
    "c2_cobalt_strike_beacon": r"(?i)/(?:beacon|implant|stage[12]?|payload)/[a-z0-9]{8,}(?:\.bin|\.exe|\.dll)?",
    "c2_dns_tunnel": r"[a-zA-Z0-9+/]{20,}\.(?:[a-z]{2,6}\.)+(?:com|net|org|io)\b",
    "wallet_bitcoin": r"\b(?:1[A-HJ-NP-Za-km-z1-9]{25,34}|3[A-HJ-NP-Za-km-z1-9]{25,34}|bc1[a-z0-9]{39,59})\b",
    "wallet_ethereum": r"\b0x[a-fA-F0-9]{40}\b",
    "wallet_monero": r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b",
    "supply_chain_npmrc": r"(?i)(?:\.npmrc|NPM_TOKEN|registry\.npmjs\.org.*authToken)",
    "supply_chain_pypi_token": r"(?i)(?:PYPI_TOKEN|pypi\.org.*token|__token__)",
    "supply_chain_aws_key": r"AKIA[0-9A-Z]{16}",
    "supply_chain_github_pat": r"gh[ps]_[A-Za-z0-9]{36}",
    "staging_curl_pipe": r"(?i)curl\s+(?:-s\s+)?https?://[^\s]+\s*\|\s*(?:sh|bash|python|perl)",
    "staging_raw_github": r"(?i)https?://raw\.githubusercontent\.com/[^/]+/[^/]+/[^/]+/[^\s\"']+\.(?:sh|py|ps1|exe|bin)",
}


def literal_counts(sources: DataFrame, text: str, keys: Sequence[str], rules: dict[str, str] = LITERAL_RULES) -> DataFrame:
    """Matches of each pattern, the number of patterns that match, and the confidence by that number."""
    out = sources.select(*keys, *[F.regexp_count(text, F.lit(p)).alias(n) for n, p in rules.items()])
    n = F.lit(0)
    for name in rules:
        n = n + (F.col(name) > 0).cast("int")
    out = out.withColumn("n_rules", n)
    return out.withColumn("confidence", F.when(F.col("n_rules") >= 4, 0.95).when(F.col("n_rules") >= 2, 0.85).when(F.col("n_rules") == 1, 0.65).otherwise(0.1))


#: Names of functions by which code is put into processes, and by which credentials are read.
INJECTION_APIS = """CreateRemoteThread CreateRemoteThreadEx NtCreateThreadEx RtlCreateUserThread QueueUserAPC NtQueueApcThread SetThreadContext WriteProcessMemory NtWriteVirtualMemory ReadProcessMemory
NtReadVirtualMemory VirtualAllocEx NtAllocateVirtualMemory VirtualProtectEx NtProtectVirtualMemory SetWindowsHookEx SetWindowsHookExA SetWindowsHookExW CallNextHookEx OpenProcess NtOpenProcess ZwOpenProcess
DuplicateHandle MiniDumpWriteDump NtQueryVirtualMemory ptrace process_vm_readv process_vm_writev dlopen""".split()
CREDENTIAL_APIS = """LsaRetrievePrivateData LsaOpenPolicy LsaQueryInformationPolicy SamQueryInformationUser SamOpenUser SamOpenDomain SamConnect NtlmHashEntryNative CryptUnprotectData CryptProtectData
BCryptOpenAlgorithmProvider NCryptOpenKey CryptAcquireContext CryptAcquireContextA CryptAcquireContextW sqlite3_open getpwuid getspnam pam_authenticate""".split()


def names_used(sources: DataFrame, text: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The names of a set that occur as whole words of a text, how many, and the confidence by that number."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    found = F.array_sort(F.array_intersect(words, F.array(*[F.lit(n) for n in names])))
    return sources.select(*keys, F.array_join(found, ",").alias("names"), F.size(found).alias("n")).filter("n > 0").withColumn("confidence", F.expr("case when n >= 5 then 0.95d when n >= 3 then 0.85d when n = 2 then 0.75d else 0.55d end"))


# --- bytes ---------------------------------------------------------------------


def entropies(sources: DataFrame, data: str, keys: Sequence[str], block: int) -> DataFrame:
    """keys, b and e: the Shannon entropy (bits a byte) of each block of a binary column, in Catalyst."""
    some = sources.select(*keys, F.col(data).alias("__d")).filter(F.length("__d") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((length(__d) - 1) div {block} as int)")), lambda i: F.hex(F.substring("__d", i * block + 1, F.lit(block))))
    blocks = some.select(*keys, F.posexplode(cut).alias("b", "h"))
    # the digits are cut by one pass of a pattern; substrings would read the block again for each byte
    bytes_ = blocks.select(*keys, "b", (F.length("h") / 2).cast("int").alias("n"), F.explode(F.regexp_extract_all("h", F.lit(".."), F.lit(0))).alias("byte"))
    counts = bytes_.groupBy(*keys, "b", "n", "byte").agg(F.count("*").alias("c"))
    return counts.groupBy(*keys, "b").agg(F.sum(-F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("n"))).alias("e"))


def block_entropy(sources: DataFrame, data: str, keys: Sequence[str], block: int = 256) -> DataFrame:
    """Mean and greatest entropy of the blocks of a binary column."""
    each = entropies(sources, data, keys, block)
    return each.groupBy(*keys).agg(F.round(F.avg("e"), 4).alias("mean_entropy"), F.round(F.max("e"), 4).alias("max_entropy"), F.count("*").alias("n_blocks"))


#: Entropy above which a chunk looks packed, share of such chunks that tells, bytes of a chunk.
PACKED_CHUNK, PACKED_SHARE, CHUNK = 7.2, 0.4, 4096


def packed_chunks(sources: DataFrame, data: str, keys: Sequence[str]) -> DataFrame:
    """n_chunks, n_high and packed of a binary column's whole chunks; one shorter than a chunk is a chunk by itself."""
    n = F.length(data)
    whole = F.when(n < CHUNK, F.col(data)).otherwise(F.substring(F.col(data), F.lit(1), (n - n % CHUNK).cast("int")))
    each = entropies(sources.withColumn("__w", whole), "__w", keys, CHUNK).groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.count_if(F.col("e") > PACKED_CHUNK).alias("n_high"))
    return each.withColumn("packed", F.col("n_high") / F.col("n_chunks") >= PACKED_SHARE)


#: packers' marks as hexadecimal digits.
PACKERS = {"UPX": "555058", "UPX!": "555058210D0A", "MPRESS": "4D5052455353", "Petite": "50455449544500", "ASPack": "6089E8", "Themida": "5468656D696461", "PECompact": "50454334"}


def packers(data: Column, within: int = 512) -> Column:
    """The packers whose mark stands on a whole byte of the first bytes, in the order of PACKERS."""
    head = F.hex(F.substring(data, 1, within))
    return F.filter(F.array(*[F.when(F.regexp_like(head, F.lit(f"^(?:..)*{mark}")), name) for name, mark in PACKERS.items()]), lambda n: n.isNotNull())
