"""Signature tables over strings and decompiled texts: malware strings, ordered calls, control flow, behaviour pairs.

Texts are tested in one projection each; sequences are folds over a text's tokens, so a text costs its length times
the number of signatures.  A null or empty text hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rules import Rule, block_entropy, rule_hits

# --- strings --------------------------------------------------------------------

#: String signatures; the category is the behaviour that a hit shows.
STRING_RULES = (
    Rule("SS_CryptoMiner_Stratum", "network", "critical", "Stratum mining protocol endpoint present in binary strings", (r"(?i)stratum\+tcp://", r"(?i)stratum\+ssl://", r"(?i)stratum\+tls://")),
    Rule("SS_CryptoMiner_XMRig", "crypto", "critical", "XMRig or Monero mining indicators in binary strings", (r"(?i)xmrig", r"(?i)monero[- _]wallet", r"(?i)xmr\.pool\.", r"(?i)coinhive\.com", r"(?i)cryptonight", r"(?i)--donate-level")),
    Rule("SS_CryptoMiner_Generic", "crypto", "high", "Generic cryptocurrency mining strings", (r"(?i)mining[- _]pool", r"(?i)hashrate[^a-z]", r"(?i)getwork\b", r"(?i)ethash", r"(?i)kawpow", r"(?i)nicehash\.com", r"(?i)2miners\.com", r"(?i)nanopool\.org"), 2),
    Rule("SS_Botnet_MiraiStrings", "network", "critical", "Mirai botnet family string indicators", (r"(?i)mirai", r"/bin/busybox\s+MIRAI", r"(?i)table_unlock_val", r"(?i)scanner_init", r"(?i)attack_kill_all")),
    Rule("SS_Botnet_DGA", "network", "high", "Potential domain generation algorithm (DGA) or hardcoded C&C domain patterns", (r"(?i)[a-z]{8,16}\.(tk|ml|ga|cf|gq)(?:/|\z)", r"(?i)[a-z]{12,20}\.xyz(?:/|\z)", r"(?i)[a-z]{8,18}\.top/[a-z0-9]{4,}", r"(?i)\b(?:185\.|91\.|194\.|45\.|23\.)\d{1,3}\.\d{1,3}\.\d{1,3}/[a-z0-9]{4,}")),
    Rule("SS_Botnet_IRC_CC", "network", "high", "IRC-based botnet C&C channel strings", (r"(?i)PRIVMSG\s+#[a-z0-9_-]+\s+:", r"(?i)JOIN\s+#[a-z0-9_-]+\s+:", r"(?i)irc\..*\.(net|org|ru|cc)\b", r"(?i)bot\.?nick\b"), 2),
    Rule("SS_Malware_CobaltStrike", "process", "critical", "Cobalt Strike beacon / stager string indicators", (r"(?i)cobalt.?strike", r"(?i)beacon\.(?:dll|exe|bin)", r"(?i)ReflectiveLoader", r"(?i)MeterPreter", r"(?i)cs\.profile", r"(?i)malleable.*c2")),
    Rule("SS_Malware_Sliver", "network", "critical", "Sliver C2 framework string indicators", (r"(?i)sliver[- _](?:implant|server|client)", r"(?i)sliverarmory\.com", r"(?i)\bsliver\b.*(?:mtls|wg|dns|https)")),
    Rule("SS_Malware_AsyncRAT", "network", "critical", "AsyncRAT / njRAT remote access trojan string indicators", (r"(?i)AsyncRAT", r"(?i)njRAT", r"(?i)QuasarRAT", r"(?i)DCRat", r"(?i)NjW0rm", r"(?i)GhostRAT", r"(?i)RemcosRAT")),
    Rule("SS_Malware_Emotet_TrickBot", "dataExfiltration", "critical", "Emotet / TrickBot banking trojan string indicators", (r"(?i)emotet", r"(?i)trickbot", r"(?i)bazarloader", r"(?i)qakbot", r"(?i)icedid", r"(?i)SystemBC")),
    Rule("SS_Malware_Lazarus", "dataExfiltration", "critical", "Lazarus Group / APT38 malware string indicators", (r"(?i)\bLazarus\b", r"(?i)AppleJeus", r"(?i)BlindingCan", r"(?i)MATA[- _]framework", r"(?i)DTrack")),
    Rule("SS_CredHarvest_CloudTokens", "dataExfiltration", "high", "Cloud provider credential or token exfiltration strings", (r"AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{35}", r"ya29\.[0-9A-Za-z_-]{68,}", r"ghp_[A-Za-z0-9]{36}", r"ghs_[A-Za-z0-9]{36}")),
    Rule("SS_CredHarvest_SSHExfil", "dataExfiltration", "high", "SSH private key or authorized_keys exfiltration", (r"(?i)BEGIN (?:RSA|EC|OPENSSH) PRIVATE KEY", r"(?i)\.ssh/authorized_keys", r"(?i)\.ssh/id_(?:rsa|ecdsa|ed25519)", r"(?i)ssh-keygen.*-f")),
    Rule("SS_AntiAnalysis_VmDetect", "obfuscation", "medium", "Virtual machine or sandbox detection strings", (r"(?i)vmware", r"(?i)VirtualBox", r"(?i)SbieDll\.dll", r"(?i)wine_get_version", r"(?i)VBOX_E_", r"(?i)\bHaRu_Dbg\b"), 2),
    Rule("SS_AntiAnalysis_DebuggerDetect", "obfuscation", "medium", "Debugger detection API or string indicators", (r"(?i)IsDebuggerPresent", r"(?i)CheckRemoteDebuggerPresent", r"(?i)NtQueryInformationProcess", r"(?i)OutputDebugString", r"(?i)anti[- _]?debug"), 2),
    Rule("SS_Ransomware_Indicators", "filesystem", "critical", "Ransomware behavior string indicators", (r"(?i)Your files have been encrypted", r"(?i)Send Bitcoin to", r"(?i)\.onion.*decrypt", r"(?i)ransom(?:note|demand|ware)", r"(?i)CryptEncrypt.*CryptDecrypt", r"(?i)vssadmin\s+delete\s+shadows")),
    Rule("SS_SupplyChain_PackageHijack", "dataExfiltration", "critical", "Package manager credential or registry token theft strings", (r"(?i)\.npmrc", r"(?i)NPM_TOKEN", r"(?i)PYPI_TOKEN", r"(?i)registry\.npmjs\.org.*authToken", r"(?i)npm login.*--auth-type"), 2),
)

#: Binary string rules; the twelfth is by entropy (below).
BINARY_RULES = (
    Rule("CryptoMiner_Strings", "crypto", "critical", "Strings associated with cryptocurrency mining", (r"(?i)stratum\+tcp", r"(?i)xmrig", r"(?i)monero", r"(?i)coinhive", r"(?i)cryptonight", r"(?i)hashrate"), 2),
    Rule("ReverseShell_Indicators", "process", "critical", "Patterns commonly found in reverse shells", (r"(?i)/bin/sh\s*-i", r"(?i)/bin/bash\s*-c", r"(?i)socket\(.*SOCK_STREAM", r"(?i)connect\(.*\d+\.\d+\.\d+\.\d+", r"(?i)exec\(.*sh"), 2),
    Rule("DataExfiltration_Patterns", "dataExfiltration", "high", "Patterns suggesting data exfiltration capabilities", (r"(?i)discord\.com/api/webhooks", r"(?i)hooks\.slack\.com", r"(?i)telegram\.org/bot", r"(?i)\.ngrok\.", r"(?i)pastebin\.com")),
    Rule("Obfuscation_Indicators", "obfuscation", "medium", "Binary appears to use obfuscation techniques", (r"(?i)UPX!", r"(?i)MPRESS", r"(?i)\.enigma", r"(?i)themida", r"\x00{100,}")),
    Rule("Keylogger_Strings", "", "high", "Strings associated with keylogging", (r"(?i)GetAsyncKeyState", r"(?i)SetWindowsHookEx", r"(?i)keyboard_event", r"(?i)keylog"), 2),
    Rule("EnvTheft_Patterns", "dataExfiltration", "high", "Attempts to read sensitive environment variables", (r"(?i)AWS_SECRET_ACCESS_KEY", r"(?i)GITHUB_TOKEN", r"(?i)NPM_TOKEN", r"(?i)DATABASE_URL", r"(?i)PRIVATE_KEY", r"(?i)API_KEY"), 3),
    Rule("ProcessInjection_APIs", "process", "high", "APIs used for process injection", (r"(?i)VirtualAllocEx", r"(?i)WriteProcessMemory", r"(?i)CreateRemoteThread", r"(?i)NtCreateThreadEx"), 2),
    Rule("DNS_Tunneling", "network", "high", "Indicators of DNS tunneling for C2 communication", (r"(?i)dns.*tunnel", r"(?i)iodine", r"(?i)dnscat", r"(?i)dns2tcp")),
    Rule("Suspicious_FileOps", "filesystem", "medium", "Suspicious file system operations", (r"(?i)/etc/passwd", r"(?i)/etc/shadow", r"(?i)\.ssh/id_rsa", r"(?i)\.gnupg", r"(?i)\.aws/credentials", r"(?i)\.npmrc"), 2),
    Rule("Network_Recon", "network", "medium", "Network scanning and reconnaissance indicators", (r"(?i)nmap", r"(?i)masscan", r"(?i)port.*scan", r"(?i)SYN_SENT")),
    Rule("Suspicious_URLs", "network", "medium", "URLs pointing to known malicious infrastructure", (r"(?i)bit\.ly", r"(?i)tinyurl\.com", r"(?i)t\.co/", r"(?i)raw\.githubusercontent\.com.*\.sh")),
)
ENTROPY_RULE, PACKED_ENTROPY = ("HighEntropy_Section", "obfuscation", "medium"), 7.5

#: The behaviour that a script rule's category shows in a binary's strings.
CATEGORY_BEHAVIOUR = {"remoteCodeExecution": "process", "reverseShell": "process", "environmentTheft": "dataExfiltration", "scriptInjection": "obfuscation", "obfuscation": "obfuscation", "wiper": "filesystem"}


def string_hits(sources: DataFrame, text: str, keys: Sequence[str], rules: Sequence[Rule] = STRING_RULES) -> DataFrame:
    """A row per text and string signature that hits: rule, behaviour, severity, matched."""
    return rule_hits(sources, text, keys, rules, evidence=False).select(*keys, "rule", F.col("category").alias("behaviour"), "severity", "matched")


def binary_hits(sources: DataFrame, text: str, data: str, keys: Sequence[str], binaries: DataFrame | None = None) -> DataFrame:
    """The binary string rules, and the entropy rule on the whole bytes, one match each.

    Bytes that lie in a table of their own (keys, data) are given as binaries: texts and bytes then never meet in a row.
    """
    packed = block_entropy(sources if binaries is None else binaries, data, keys, block=1 << 30).filter(F.col("max_entropy") > PACKED_ENTROPY)
    rule, behaviour, severity = (F.lit(v) for v in ENTROPY_RULE)
    return string_hits(sources, text, keys, BINARY_RULES).unionByName(packed.select(*keys, rule.alias("rule"), behaviour.alias("behaviour"), severity.alias("severity"), F.lit(1).alias("matched")))


def heuristic_behaviours(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Script rule hits on a binary's strings as behaviours: n_details, and confidence 0.75 as there is a hit."""
    shown = F.lit(None).cast("string")
    for category, behaviour in CATEGORY_BEHAVIOUR.items():
        shown = F.when(F.col("category") == category, behaviour).otherwise(shown)
    out = hits.withColumn("behaviour", shown).filter("behaviour is not null")
    return out.groupBy(*keys, "behaviour").agg(F.count("*").alias("n_details"), F.lit(0.75).alias("confidence"))


# --- behaviour pairs --------------------------------------------------------------

#: A profile shows where both of its groups of patterns do (id, severity, behaviour, groups).
COORDINATED = (
    ("CORR_ExfilC2", "critical", "dataExfiltration",
     (r"(?i)LsaRetrievePrivateData", r"(?i)LsaOpenPolicy", r"(?i)SamQueryInformationUser", r"(?i)CryptUnprotectData", r"(?i)CryptAcquireContext", r"(?i)NtlmHashEntryNative", r"(?i)MiniDumpWriteDump", r"(?i)ReadProcessMemory", r"(?i)NtReadVirtualMemory", r"(?i)getpwuid", r"(?i)getspnam", r"(?i)sqlite3_open"),
     (r"\bWSAStartup\b", r"\bconnect\s*\(", r"\bsend\s*\(", r"\brecv\s*\(", r"\bsocket\s*\(", r"(?i)exfil", r"(?i)\bcurl\b.*https?://", r"(?i)discord(?:app)?\.com/api/webhooks", r"(?i)hooks\.slack\.com", r"(?i)api\.telegram\.org/bot", r"\bAF_INET\b", r"\bSOCK_STREAM\b")),
    ("CORR_PersistWiper", "critical", "filesystem",
     (r"(?i)RegSetValueEx", r"(?i)RegCreateKey", r"(?i)RegOpenKey", r"(?i)HKEY_CURRENT_USER\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", r"(?i)HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run", r"(?i)schtasks", r"(?i)at\.exe", r"(?i)Startup\\", r"(?i)crontab", r"(?i)rc\.local", r"(?i)\.bash_profile", r"(?i)\.bashrc", r"(?i)systemd.*enable"),
     (r"(?i)vssadmin\s+delete\s+shadows", r"(?i)wbadmin\s+delete", r"(?i)bcdedit.*recoveryenabled\s+no", r"(?i)\bDeleteFileW?\b", r"(?i)\bRemoveDirectoryW?\b", r"(?i)shred\s+-", r"(?i)rm\s+-rf\b", r"(?i)unlink\s*\(", r"(?i)\.encrypted", r"(?i)\.locked", r"(?i)\.crypt\z")),
    ("CORR_InjectSpawn", "critical", "process",
     (r"(?i)CreateRemoteThread", r"(?i)CreateRemoteThreadEx", r"(?i)NtCreateThreadEx", r"(?i)RtlCreateUserThread", r"(?i)WriteProcessMemory", r"(?i)NtWriteVirtualMemory", r"(?i)VirtualAllocEx", r"(?i)NtAllocateVirtualMemory", r"(?i)SetWindowsHookEx", r"(?i)QueueUserAPC", r"(?i)NtQueueApcThread", r"\bptrace\b", r"(?i)process_vm_writev", r"dlopen\s*\("),
     (r"(?i)CreateProcess", r"(?i)CreateProcessAsUser", r"(?i)ShellExecute", r"(?i)WinExec", r"(?i)NtCreateProcess", r"\bfork\s*\(\s*\)", r"\bexecve?\s*\(", r"\bexeclp?\s*\(", r"\bpopen\s*\(", r"\bsystem\s*\(", r"(?i)cmd\.exe", r"(?i)powershell")),
    ("CORR_CryptoStealing", "high", "crypto",
     (r"\b(?:1[A-HJ-NP-Za-km-z1-9]{25,34}|3[A-HJ-NP-Za-km-z1-9]{25,34}|bc1[a-z0-9]{39,59})\b", r"\b0x[a-fA-F0-9]{40}\b", r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b", r"(?i)wallet\.dat", r"(?i)keystore.*ethereum", r"(?i)mnemonic(?:\s+phrase)?", r"(?i)seed phrase", r"(?i)private key"),
     (r"(?i)libcrypto", r"(?i)openssl", r"(?i)BCryptOpenAlgorithmProvider", r"(?i)CryptAcquireContext", r"(?i)CryptEncrypt", r"(?i)CryptDecrypt", r"(?i)libbitcoin", r"(?i)bitcoin.*core", r"(?i)go-ethereum", r"(?i)web3", r"(?i)ethers", r"(?i)monero.*wallet")),
)


def coordinated(sources: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """A row per text and coordinated profile: profile, severity, behaviour."""

    def any_of(patterns: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | F.col(text).rlike(p)
        return out

    shown = [F.when(any_of(a) & any_of(b), F.struct(F.lit(p).alias("profile"), F.lit(s).alias("severity"), F.lit(c).alias("behaviour"))) for p, s, c, a, b in COORDINATED]
    return sources.select(*keys, F.explode_outer(F.filter(F.array(*shown), lambda x: x.isNotNull())).alias("h")).filter("h is not null").select(*keys, "h.*")


# --- system calls in order ----------------------------------------------------------

#: Names of system calls by family, numbers that stand for some of them, and attack sequences of slots.
MEMORY_CALLS = "mprotect mmap mmap2 munmap mremap memfd_create shmat shmget".split()
PROCESS_CALLS = "clone fork vfork clone3 execve execveat ptrace process_vm_readv process_vm_writev pidfd_open pidfd_getfd".split()
FILE_CALLS = "open openat openat2 creat read write pread64 pwrite64 chmod fchmod fchmodat".split()
NETWORK_CALLS = "socket connect bind listen accept accept4 send sendto sendmsg recv recvfrom recvmsg".split()
SANDBOX_CALLS = "prctl seccomp unshare setns pivot_root chroot userfaultfd modify_ldt iopl".split()
CALL_NUMBERS = {9: "mmap", 10: "mprotect", 56: "clone", 57: "fork", 59: "execve", 101: "ptrace", 310: "process_vm_readv", 311: "process_vm_writev", 319: "memfd_create", 317: "seccomp", 272: "unshare"}
SEQUENCES = {
    "code_injection_mprotect": "mprotect > memcpy memmove write > call jmp ret",
    "code_injection_mmap": "mmap mmap2 > mprotect > execve call jmp",
    "process_injection_clone_execve": "clone fork vfork > execve execveat",
    "process_injection_ptrace": "ptrace > process_vm_writev write pwrite64",
    "persistence_write_chmod": "open openat creat > write pwrite64 > chmod fchmod fchmodat",
    "sandbox_escape_unshare": "unshare setns > pivot_root chroot",
    "network_c2_recv_exec": "socket > connect > recv recvfrom recvmsg > mprotect > call jmp",
    "network_exfil_send": "open openat > read pread64 > socket > connect > send sendto sendmsg",
    "cred_theft_shadow_read": "open openat > read pread64",
}
SENSITIVE_PATH = r"(?i)/etc/(?:shadow|passwd|gshadow|sudoers|ssh/|ssl/private)"
NEEDS_PATH = ("cred_theft_shadow_read",)
#: Where system calls are named, in this order, and whether the name must be a known one.
CALL_MARKS = (
    (r";\s*(?:SYS_)?(\w+)\s*(?:\(syscall\))?", True),
    (r"(?:__NR_|SYS_)(\w+)", False),
    (r"(?i)\bsyscall\s*\(\s*(?:SYS_|__NR_)?(\w+)", True),
    (r"\b(mprotect|mmap|mmap2|execve|execveat|clone|fork|vfork|ptrace|process_vm_writev|process_vm_readv|memfd_create|unshare|setns|prctl|seccomp|pivot_root|chroot)\s*\(", False),
)
CALL_NUMBER = r"\bmov\s+(?:eax|rax)\s*,\s*(0x[0-9a-fA-F]+|\d+)"


def _ascii(pattern: str) -> str:
    """The pattern with word boundaries between ASCII letters and others, whatever the Java version takes for a word."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def slots(sequence: str) -> list[list[str]]:
    return [s.split() for s in sequence.split(" > ")]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _numbered(found: Column, numbers: dict[int, str]) -> Column:
    """Names of numbers, which are read as hexadecimal digits with or without 0x."""
    names = F.create_map(*[F.lit(v) for n, name in numbers.items() for v in (format(n, "x"), name)])
    return F.transform(found, lambda x: F.try_element_at(names, F.regexp_replace(F.lower(x), "^(?:0x)?0*", "")))


def _once(df: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    """The keys and columns, each worked out once a row: the optimiser doesn't copy expressions through an explode."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keys, F.explode(F.array(row)).alias("__row")).select(*keys, "__row.*")


def in_slots(tokens: Column, chain: Sequence[Sequence[str]], within: bool = False) -> Column:
    """Whether tokens fill the slots in order, with anything between; within: a token may merely contain a name."""
    wanted = F.array(*[_strings(s) for s in chain])
    fits = (lambda at, w: F.exists(F.get(wanted, at), lambda a: w.contains(a))) if within else (lambda at, w: F.array_contains(F.get(wanted, at), w))
    return F.aggregate(tokens, F.lit(0), lambda at, w: F.when((at < len(chain)) & fits(at, w), at + 1).otherwise(at)) == len(chain)


def system_calls(text: Column) -> Column:
    """Names of system calls in a text: those of each kind of mark in order, one kind after the other."""
    known = _strings(MEMORY_CALLS + PROCESS_CALLS + FILE_CALLS + NETWORK_CALLS + SANDBOX_CALLS)
    parts = []
    for pattern, must in CALL_MARKS:
        names = F.transform(F.regexp_extract_all(text, F.lit(_ascii(pattern)), F.lit(1)), F.lower)
        parts.append(F.filter(names, lambda n: F.array_contains(known, n)) if must else names)
    numbered = _numbered(F.regexp_extract_all(text, F.lit(_ascii(CALL_NUMBER)), F.lit(1)), CALL_NUMBERS)
    return F.concat(*parts, F.filter(numbered, lambda n: n.isNotNull()))


def call_sequences(sources: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Texts with an attack sequence (matched), or else with three suspicious calls at least (suspicious); confidence by how many."""
    base = _once(sources, keys, __c=system_calls(F.col(text)), __p=F.col(text).rlike(SENSITIVE_PATH))
    hits = [F.when(in_slots(F.col("__c"), slots(s)) & (F.col("__p") if name in NEEDS_PATH else F.lit(True)), F.lit(name)) for name, s in SEQUENCES.items()]
    found = _once(base, keys, __m=F.filter(F.array(*hits), lambda x: x.isNotNull()), __s=F.array_sort(F.array_intersect("__c", _strings(PROCESS_CALLS + MEMORY_CALLS))))
    n = F.size("__m")
    some = found.filter((n > 0) | (F.size("__s") >= 3))
    confidence = F.when(n >= 3, 0.95).when(n == 2, 0.88).when(n == 1, 0.80).otherwise(0.55)
    return some.select(*keys, F.array_join("__m", ",").alias("matched"), F.when(n == 0, F.array_join("__s", ",")).otherwise("").alias("suspicious"), confidence.alias("confidence"))


# --- call chains and control flow ------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    id: str
    slots: str
    confidence: float
    #: One of these must occur in the text, in any case of letters; none: no condition.
    context: tuple[str, ...] = ()


#: Call chains as slots of names, their confidence and context.
CHAINS = (
    Chain("fork_exec_socket_c2", "fork vfork clone > execve execveat execl execle execv execvp > socket", 0.80),
    Chain("mmap_memcpy_jmp_shellcode", "mmap > memcpy memmove memset > jmp call", 0.85),
    Chain("open_read_exfiltrate", "open fopen openat > read fread pread pread64 > send sendto write sendmsg", 0.78, ("socket", "connect")),
    Chain("dlopen_dlsym_shellcode_load", "dlopen > dlsym > call jmp", 0.82),
    Chain("ptrace_writevm_exec", "ptrace process_vm_writev > execve execveat", 0.88),
    Chain("socket_connect_recv_mprotect_call", "socket > connect > recv recvfrom recvmsg > mprotect > call jmp", 0.90),
    Chain("setuid_execve_priv_esc", "setuid setgid setreuid setresuid > execve execveat system", 0.80, ("0",)),
    Chain("mmap_mprotect_exec_load", "mmap > mprotect > call jmp execve", 0.85),
    Chain("fork_socket_connect_loop_c2", "fork clone > socket > connect", 0.75),
    Chain("open_write_chmod_persistence", "open fopen openat creat > write fwrite pwrite > chmod fchmod fchmodat", 0.78),
    Chain("open_shadow_read_send", "open fopen openat > read fread > send sendto write", 0.90, ("/etc/shadow", "/etc/passwd", "/etc/gshadow")),
    Chain("getenv_strstr_send_token", "getenv > strstr strncmp strcmp memcmp > send sendto write fwrite", 0.83, ("TOKEN", "SECRET", "KEY", "PASSWORD", "AWS", "NPM")),
    Chain("readlink_proc_maps_scan", "readlink open fopen > read fread > strstr memmem memcmp", 0.82, ("/proc/", "maps", "mem")),
    Chain("unshare_pivot_root_escape", "unshare setns > pivot_root chroot", 0.88),
    Chain("prctl_seccomp_bypass", "prctl > seccomp", 0.75),
    Chain("memfd_create_exec_memfd", "memfd_create > write fwrite pwrite > execve execveat fexecve", 0.92),
    Chain("xmrig_socket_stratum_connect", "socket > connect > send sendto write", 0.80, ("stratum", "pool", "xmr", "monero", "mining")),
    Chain("fork_exec_xmrig", "fork clone > execve execvp system", 0.85, ("xmrig", "minerd", "cpuminer", "cryptominer")),
    Chain("jndi_ldap_rce_chain", "lookup jndi_lookup getattributes > loadclass forname class_forname > exec runtime_exec execve", 0.88, ("ldap", "jndi", "rmi", "dns")),
    Chain("ld_preload_hijack", "open fopen openat creat > write fwrite", 0.88, ("ld.so.preload", "LD_PRELOAD")),
    Chain("crontab_write_persistence", "open fopen openat creat > write fputs fprintf", 0.82, ("cron", "crontab", "/etc/cron", "/var/spool/cron")),
    Chain("ioctl_dev_mem_raw_access", "open fopen > ioctl mmap", 0.90, ("/dev/mem", "/dev/kmem", "/proc/kcore")),
    Chain("solarwinds_dll_sideload", "loadlibrary loadlibrarya loadlibraryw loadlibraryex > getprocaddress > call jmp", 0.87),
    Chain("recv_decrypt_exec", "recv recvfrom read > decrypt aes_decrypt rc4 xor decode > execve exec call jmp mprotect", 0.85),
    Chain("bpf_prog_load_hide", "bpf syscall > socket setsockopt", 0.85, ("BPF_PROG_LOAD", "BPF_MAP_CREATE", "bpf_prog")),
    Chain("dirty_pipe_write_pipe", "pipe pipe2 > splice sendfile > write pwrite", 0.83),
    Chain("process_hollow_createprocess", "createprocess createprocessa createprocessw > writeprocessmemory ntwritevirtualmemory > resumethread ntresumethread", 0.90),
)
#: Words that aren't calls, of which the first begin no call's name either; calls that a comment may name; numbers.
NOT_BEGUN = "if else while for switch return sizeof typeof struct enum void int char long short unsigned static extern const volatile".split()
KEYWORDS = """if else while for switch return sizeof typeof struct enum void int char long short unsigned signed static extern const volatile register do break continue case default goto typedef union
true false null nullptr new delete this class public private protected virtual override inline template namespace using try catch throw""".split()
COMMENT_CALLS = """read write open close mmap mprotect munmap socket connect bind listen accept sendto recvfrom clone fork vfork execve exit kill ptrace setuid setgid prctl unshare seccomp memfd_create
execveat process_vm_readv process_vm_writev""".split()
NODE_NUMBERS = {0: "read", 1: "write", 2: "open", 3: "close", 9: "mmap", 10: "mprotect", 11: "munmap", 20: "writev", 39: "getpid", 41: "socket", 42: "connect", 43: "accept", 44: "sendto", 45: "recvfrom", 56: "clone", 57: "fork", 58: "vfork", 59: "execve", 60: "exit", 62: "kill", 87: "unlink", 101: "ptrace", 105: "setuid", 157: "prctl", 186: "gettid", 200: "tkill", 272: "unshare", 293: "sendmmsg", 310: "process_vm_readv", 311: "process_vm_writev", 317: "seccomp", 319: "memfd_create", 322: "execveat"}
#: How a call looks: name and bracket, mnemonic, marked name, comment, number.
NAMED = r"\b([a-z_][a-z0-9_]{1,63})\s*\("
MNEMONIC = r"\bcall[qlw]?\s+(?:0x[0-9a-f]+\s+<)?([a-z_@][a-z0-9_.@+<>-]{0,63})>?"
MARKED = r"(?:__NR_|SYS_)([a-z_][a-z0-9_]+)"
COMMENT = r";\s*(?:SYS_)?([a-z_][a-z0-9_]+)\s*(?:\(syscall\))?"
NUMBERED = r"\bmov\s+(?:eax|rax)\s*,\s*(0x[0-9a-f]+|\d+)"


def call_nodes(text: Column) -> Column:
    """Lower-case names of the calls of a text in order of their places, one a place.

    A look-ahead stands at every place, so kinds of calls may overlap and the first that fits a place counts.
    """
    # a name is taken whole, as no shorter one is followed by a bracket
    kinds = [NAMED.replace("{1,63}", "{1,63}+"), MNEMONIC, MARKED, COMMENT, NUMBERED]
    plain = [re.sub(r"(?<!\\)\((?!\?)", "(?:", k) for k in kinds]
    found = F.regexp_extract_all(text, F.lit(_ascii(f"(?i)(?=({'|'.join(plain)}))")), F.lit(1))

    def name(m: Column) -> Column:
        part = lambda p: F.lower(F.regexp_extract(m, f"(?i)^{p}", 1))
        called = F.regexp_replace(F.regexp_replace(part(MNEMONIC), "@plt$", ""), "<[^>]+>$", "")
        commented, named = part(COMMENT), part(NAMED)
        return (
            F.when(m.endswith("("), F.when(~named.isin(KEYWORDS) & ~named.rlike(f"^(?:{'|'.join(NOT_BEGUN)})"), named))
            .when(m.startswith(";"), F.when(commented.isin(COMMENT_CALLS), commented))
            .when(m.rlike(r"(?i)^call[qlw]?\s"), F.when(~called.isin("", *KEYWORDS), called))
            .when(m.rlike(r"(?i)^mov\s"), F.get(_numbered(F.array(F.regexp_extract(m, f"(?i)^{NUMBERED}", 1)), NODE_NUMBERS), F.lit(0)))
            .otherwise(part(MARKED))
        )

    return F.filter(F.transform(found, name), lambda n: n.isNotNull())


#: Mnemonics and frames that control flow is judged by.
JUMPS = r"(?i)\b(?:jmp|jz|jnz|je|jne|jl|jle|jg|jge|ja|jae|jb|jbe|js|jns|jc|jnc|jo|jno|jp|jnp|jpe|jpo|loop|loope|loopne)\b"
PROLOGUE = r"(?i)(?:push\s+(?:rbp|ebp)|mov\s+(?:rbp|ebp)\s*,\s*(?:rsp|esp))"
EPILOGUE = r"(?i)(?:pop\s+(?:rbp|ebp)|leave|retn?(?:\s+\d+)?)"
INSTRUCTIONS = r"(?i)\b(?:mov|push|pop|xor|add|sub|lea|call|jmp|ret)\b"
INDIRECT = r"(?i)(?:\(\*[a-z_]\w*\)\s*\(|call\s+(?:rax|rbx|rcx|rdx|rsi|rdi|r8|r9|r10|r11|r12|r13|r14|r15|\[))"


def control_flow(text: Column, window: int = 512) -> Column:
    """struct<jumps, prologue, epilogue, dispatch>: severity of each anomaly or null, and max_jumps, n_dispatch.

    Jumps are counted in whole windows of code points from the start; a shorter text is one window.
    """
    count = lambda t, p: F.regexp_count(t, F.lit(_ascii(p)))
    whole = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{{window}}}"), F.lit(0)), lambda w: count(w, JUMPS)))
    jumps = F.when(F.length(text) < window, count(text, JUMPS)).otherwise(whole)
    busy, dispatch = count(text, INSTRUCTIONS) > 20, count(text, INDIRECT)
    return F.struct(
        jumps.alias("max_jumps"),
        F.when(jumps > 20, "high").when(jumps > 10, "medium").alias("jumps"),
        F.when(busy & ~text.rlike(PROLOGUE), "low").alias("prologue"),
        F.when(busy & ~text.rlike(EPILOGUE), "low").alias("epilogue"),
        dispatch.alias("n_dispatch"),
        F.when(dispatch >= 6, "high").when(dispatch >= 3, "medium").alias("dispatch"),
    )


def flow_anomalies(sources: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Texts with an anomaly of control flow."""
    return _once(sources, keys, f=control_flow(F.col(text))).select(*keys, "f.*").filter("coalesce(jumps, prologue, epilogue, dispatch) is not null")


def call_chains(sources: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Texts with a call chain or a medium or high anomaly: signatures, n_signatures, confidence.

    Confidence is that of the surest chain, 0.03 for each further one (0.1 at most) and 0.05 for a high anomaly, 0.95
    at most; without a chain 0.6 with a high anomaly, else 0.5.
    """
    every = sorted({n for c in CHAINS for s in slots(c.slots) for n in s})
    sources = _once(sources, [*keys, text], __low=F.lower(F.col(text)))
    low = F.col("__low")
    met = {c.id: _any_within(low, c.context) for c in CHAINS}
    # only tokens that can fill a slot are folded over, and only texts that may fill all slots of a chain are cut into
    # tokens: these stand in the text, or are numbers that are moved
    may = low.contains("mov")
    for c in CHAINS:
        filled = met[c.id]
        for names in slots(c.slots):
            filled = filled & _any_within(low, names)
        may = may | filled
    nodes = F.when(may, F.filter(call_nodes(F.col(text)), lambda n: n.rlike("|".join(every)))).otherwise(F.array().cast("array<string>"))
    base = _once(sources, keys, __n=nodes, __x=F.struct(*[m.alias(i) for i, m in met.items()]), __f=control_flow(F.col(text)))
    hit = lambda c: F.when(F.col("__x")[c.id] & in_slots(F.col("__n"), slots(c.slots), within=True), F.struct(F.lit(c.id).alias("id"), F.lit(c.confidence).alias("c")))
    found = _once(base, keys, __m=F.filter(F.array(*[hit(c) for c in CHAINS]), lambda x: x.isNotNull()), __a=F.array("__f.jumps", "__f.dispatch"))
    high = F.coalesce(F.exists("__a", lambda s: s == "high"), F.lit(False))
    n = F.size("__m")
    sure = F.least(F.lit(0.95), F.array_max("__m.c") + F.least(F.lit(0.1), (n - 1) * 0.03) + F.when(high, 0.05).otherwise(0.0))
    out = found.filter((n > 0) | (F.size(F.array_compact("__a")) > 0))
    return out.select(*keys, F.array_join("__m.id", ",").alias("signatures"), n.alias("n_signatures"), F.round(F.when(n > 0, sure).when(high, 0.6).otherwise(0.5), 4).alias("confidence"))


def _any_within(text: Column, parts: Sequence[str]) -> Column:
    if not parts:
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p.lower())
    return out


# --- compiled extensions ------------------------------------------------------------------

#: Words that make a pattern: name, severity, least number, whether letters' case counts, words.
EXTENSION_PATTERNS = (
    ("process_injection", "high", 1, False, "VirtualAlloc WriteProcessMemory CreateRemoteThread NtCreateThreadEx NtAllocateVirtualMemory mprotect process_vm_writev ptrace dlopen dlsym"),
    ("network_staging", "high", 2, False, "network_staging socket connect recv c2_download exfil"),
    ("credential_access", "high", 1, False, "/etc/shadow /etc/passwd GetUserNameA GetUserNameW LSALogonUser CryptAcquireContext CredRead SecretService keychain"),
    ("dynamic_code_execution", "medium", 1, True, "PyRun_SimpleString PyEval_EvalCode eval( exec( __import__"),
)
EXTENSION_POINTS = {"critical": 40, "high": 25, "medium": 15, "low": 5, "info": 0}
EXTENSION_ENTROPY = 7.2


def extension_risk(sources: DataFrame, signals: str, entropy: str, percentile: str, keys: Sequence[str]) -> DataFrame:
    """patterns, base_score (the points of their severities, 100 at most) and risk_score with the exploit-probability boost."""
    text = F.coalesce(F.col(signals), F.lit(""))
    low = F.lower(text)
    shown, total = [], F.lit(0)
    for name, severity, least, exact, words in EXTENSION_PATTERNS:
        n = F.lit(0)
        for w in words.split():
            n = n + (text.contains(w) if exact else low.contains(w.lower())).cast("int")
        shown.append((name, severity, n >= least))
    shown.insert(1, ("high_entropy", "medium", F.coalesce(F.col(entropy) >= EXTENSION_ENTROPY, F.lit(False))))
    for _, severity, hit in shown:
        total = total + F.when(hit, EXTENSION_POINTS[severity]).otherwise(0)
    names = F.array_join(F.array_compact(F.array(*[F.when(hit, name) for name, _, hit in shown])), ",")
    out = sources.select(*keys, names.alias("patterns"), F.least(F.lit(100), total).alias("base_score"), F.col(percentile).alias("__p"))
    return out.withColumn("risk_score", F.least(F.lit(100), F.col("base_score") + S.epss_boost(F.col("__p"), "d"))).drop("__p")
