"""Lookups of weaknesses: types, scores, sections and texts of a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base score and vector by type and severity, in the order they are listed.
_V = "CVSS:3.1/AV:N/"
CVSS = {
    ("sql_injection", "critical"): (9.8, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), ("sql_injection", "high"): (8.6, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"),
    ("sql_injection", "medium"): (6.3, "AC:L/PR:L/UI:N/S:U/C:L/I:L/A:L"), ("command_injection", "critical"): (9.8, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("command_injection", "high"): (8.4, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"), ("code_injection", "critical"): (9.8, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("code_injection", "high"): (8.4, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"), ("ssti", "critical"): (9.8, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("ssti", "high"): (8.4, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"), ("xss", "high"): (7.5, "AC:L/PR:N/UI:R/S:C/C:H/I:L/A:N"),
    ("xss", "medium"): (5.4, "AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"), ("xss", "critical"): (8.2, "AC:L/PR:N/UI:R/S:C/C:H/I:H/A:N"),
    ("ssrf", "critical"): (9.1, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"), ("ssrf", "high"): (8.6, "AC:L/PR:N/UI:N/S:C/C:H/I:N/A:N"),
    ("ssrf", "medium"): (6.5, "AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N"), ("path_traversal", "high"): (7.5, "AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"),
    ("path_traversal", "critical"): (9.1, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"), ("deserialization", "critical"): (9.8, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("deserialization", "high"): (8.1, "AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H"), ("auth_bypass", "critical"): (9.1, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"),
    ("auth_bypass", "high"): (8.1, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N"), ("idor", "high"): (7.5, "AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"),
    ("idor", "medium"): (5.3, "AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N"), ("xxe", "critical"): (9.8, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("xxe", "high"): (8.6, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N"), ("crypto_weakness", "high"): (7.5, "AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"),
    ("crypto_weakness", "medium"): (5.9, "AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N"), ("csrf", "high"): (8.1, "AC:L/PR:N/UI:R/S:U/C:H/I:H/A:N"),
    ("csrf", "medium"): (6.5, "AC:L/PR:N/UI:R/S:U/C:L/I:L/A:N"), ("info_disclosure", "medium"): (5.3, "AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N"),
    ("info_disclosure", "high"): (7.5, "AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"), ("open_redirect", "medium"): (6.1, "AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    ("open_redirect", "low"): (4.3, "AC:L/PR:N/UI:R/S:U/C:N/I:L/A:N"), ("race_condition", "high"): (7.0, "AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("business_logic", "high"): (7.5, "AC:L/PR:N/UI:N/S:U/C:N/I:H/A:N"), ("business_logic", "medium"): (5.3, "AC:L/PR:N/UI:N/S:U/C:N/I:L/A:N"),
}
# What holds for a severity where the type has no score, and for no severity.
SEVERITIES = ("critical", "high", "medium", "low")
FALLBACK = {
    "critical": (9.0, "AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"), "high": (7.5, "AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N"),
    "medium": (5.3, "AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N"), "low": (3.1, "AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N"), "": (5.0, "AC:L/PR:N/UI:N/S:U/C:N/I:L/A:N"),
}
# The weakness of each type.
CWE_OF = {
    "sql_injection": "CWE-89", "command_injection": "CWE-78", "code_injection": "CWE-94", "xss": "CWE-79", "ssrf": "CWE-918", "ssti": "CWE-1336",
    "path_traversal": "CWE-22", "file_inclusion": "CWE-98", "open_redirect": "CWE-601", "deserialization": "CWE-502", "xxe": "CWE-611",
    "auth_bypass": "CWE-287", "idor": "CWE-639", "csrf": "CWE-352", "crypto_weakness": "CWE-327", "info_disclosure": "CWE-200",
    "header_injection": "CWE-113", "injection_general": "CWE-74", "format_string": "CWE-134", "log_injection": "CWE-117", "nosql_injection": "CWE-943",
    "jndi_injection": "CWE-917", "ldap_injection": "CWE-90", "xpath_injection": "CWE-643", "cleartext_transmission": "CWE-319", "config_issue": "CWE-16",
    "missing_auth": "CWE-306", "dangerous_call": "CWE-676", "business_logic": "CWE-840", "secret": "CWE-798",
}
# Names of weaknesses.
CWE_NAMES = {
    "CWE-89": "SQL Injection", "CWE-79": "Cross-Site Scripting (XSS)", "CWE-78": "Command Injection", "CWE-918": "Server-Side Request Forgery (SSRF)",
    "CWE-22": "Path Traversal", "CWE-94": "Code Injection", "CWE-1336": "Server-Side Template Injection (SSTI)", "CWE-502": "Insecure Deserialization",
    "CWE-611": "XML External Entity Injection (XXE)", "CWE-287": "Authentication Bypass", "CWE-639": "Insecure Direct Object Reference (IDOR)",
    "CWE-352": "Cross-Site Request Forgery (CSRF)", "CWE-601": "Open Redirect", "CWE-200": "Information Disclosure", "CWE-327": "Weak Encryption Algorithm",
    "CWE-916": "Weak Password Hashing", "CWE-798": "Hardcoded Credentials", "CWE-862": "Missing Authorization Check", "CWE-434": "Unrestricted File Upload",
    "CWE-400": "Uncontrolled Resource Consumption", "CWE-362": "Race Condition", "CWE-470": "Unsafe Reflection", "CWE-95": "Eval Injection",
    "CWE-77": "Command Injection (Generic)", "CWE-209": "Information Exposure Through Error Messages", "CWE-732": "Incorrect Permission Assignment",
    "CWE-284": "Improper Access Control", "CWE-840": "Business Logic Error", "CWE-269": "Improper Privilege Management",
    "CWE-306": "Missing Authentication for Critical Function", "CWE-384": "Session Fixation", "CWE-613": "Insufficient Session Expiration", "CWE-614": "Missing Secure Cookie Flag",
}
# Section, prefix of its ids, and the types in it with their display names. The order is that of a report.
SECTIONS = (
    ("Injection Vulnerabilities", "INJ", {
        "sql_injection": "SQL Injection", "command_injection": "Command Injection", "code_injection": "Code Injection", "ssti": "Server-Side Template Injection",
        "nosql_injection": "NoSQL Injection", "jndi_injection": "JNDI Injection", "ldap_injection": "LDAP Injection", "xpath_injection": "XPath Injection",
        "injection_general": "General Injection", "format_string": "Format String", "log_injection": "Log Injection", "header_injection": "Header Injection",
    }),
    ("Cross-Site Scripting (XSS)", "XSS", {"xss": "Cross-Site Scripting"}),
    ("Server-Side Request Forgery (SSRF)", "SSRF", {"ssrf": "Server-Side Request Forgery"}),
    ("Broken Authentication & Access Control", "AUTH", {
        "auth_bypass": "Authentication Bypass", "missing_auth": "Missing Authentication", "idor": "Insecure Direct Object Reference", "csrf": "Cross-Site Request Forgery",
    }),
    ("Path Traversal", "PATH", {"path_traversal": "Path Traversal", "file_inclusion": "File Inclusion"}),
    ("Insecure Deserialization", "DESER", {"deserialization": "Insecure Deserialization"}),
    ("XML External Entity (XXE)", "XXE", {"xxe": "XML External Entity"}),
    ("Security Misconfiguration", "CONFIG", {
        "config_issue": "Configuration Issue", "crypto_weakness": "Cryptographic Weakness", "cleartext_transmission": "Cleartext Transmission",
        "dangerous_call": "Dangerous Function Call", "secret": "Hardcoded Secret", "info_disclosure": "Information Disclosure",
    }),
    ("Business Logic Errors", "BIZ", {"business_logic": "Business Logic Error"}),
    ("Open Redirect", "REDIR", {"open_redirect": "Open Redirect"}),
)
ORDER = tuple(s[0] for s in SECTIONS) + ("Other",)
# Families of weaknesses that count as near.
FAMILIES = (
    ("CWE-89", "CWE-564", "CWE-943"), ("CWE-79", "CWE-80", "CWE-81", "CWE-83", "CWE-84", "CWE-85", "CWE-86", "CWE-87"), ("CWE-918",), ("CWE-77", "CWE-78"),
    ("CWE-22", "CWE-23", "CWE-35", "CWE-36", "CWE-37", "CWE-40"), ("CWE-502", "CWE-470"), ("CWE-601",), ("CWE-611", "CWE-827"), ("CWE-352", "CWE-1275"),
    ("CWE-862", "CWE-863", "CWE-284", "CWE-285", "CWE-287", "CWE-306"), ("CWE-798", "CWE-259", "CWE-260", "CWE-261", "CWE-312", "CWE-313"),
    ("CWE-200", "CWE-209", "CWE-532", "CWE-538", "CWE-548"), ("CWE-326", "CWE-327", "CWE-328", "CWE-338", "CWE-347"), ("CWE-94", "CWE-95", "CWE-1336"),
)
#: What a finding of a section lets an attacker do, what it takes, and what shows it; in our words.
TEXTS = {
    "INJ": ("Input runs as part of a command or a query: data can be read or changed, code may run.", "A request whose input reaches the statement unescaped.", "A marker sent as input comes back as the result of an evaluation."),
    "XSS": ("Script runs in another user's browser with that user's session.", "A victim opens a page that shows the input.", "A harmless marker element turns up unescaped in the page."),
    "SSRF": ("The server fetches addresses that only it can reach.", "An address or a part of one comes from the request.", "A listener under the tester's control receives the server's request."),
    "AUTH": ("Functions or records of others can be used without the right to.", "The route is reachable, with another account or none.", "The same request works without a session or with another user's."),
    "PATH": ("Files outside the intended folder can be read or written.", "A file name comes from the request.", "A known file outside the folder is returned."),
    "DESER": ("Objects built from input may run code on the server.", "Serialised input is accepted from the request.", "A harmless test object shows an observable effect."),
    "XXE": ("Files or internal addresses are read by the XML parser.", "XML input with entities is accepted.", "An entity of a known value is resolved in the answer."),
    "CONFIG": ("Settings or secrets weaken other protections.", "Access to the exposed setting or value.", "The setting is seen in the running system."),
    "BIZ": ("Steps of a process can be skipped or repeated to someone's loss.", "An account that may start the process.", "The process ends in a state that its rules exclude."),
    "REDIR": ("Users are led to addresses of an attacker from a trusted link.", "A target address comes from the request.", "The answer redirects to a test address."),
    "OTHER": ("The effect depends on where the code is used.", "The code is reachable.", "A review confirms the path."),
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def _get(pairs: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(_map(pairs), key), default if isinstance(default, Column) else F.lit(default))


def cwe_of(kind: Column) -> Column:
    """The weakness of a type, empty if unknown."""
    return _get(CWE_OF, kind, "")


def cwe_name(cwe: Column) -> Column:
    return _get(CWE_NAMES, cwe, "")


def _score(pair: tuple[float, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("score"), F.lit(_V + pair[1]).alias("vector"))


def cvss_of(kind: Column, severity: Column) -> Column:
    """struct<score, vector>: of type and severity, else of the type's highest severity, else of the severity alone."""
    exact = {f"{k}|{s}": _score(v) for (k, s), v in CVSS.items()}
    first = {}
    for s in SEVERITIES:
        for (k, at), v in CVSS.items():
            if at == s:
                first.setdefault(k, _score(v))
    alone = F.coalesce(F.try_element_at(_map({k: _score(v) for k, v in FALLBACK.items() if k}), severity), _score(FALLBACK[""]))
    return F.coalesce(F.try_element_at(_map(exact), F.concat_ws("|", kind, severity)), F.try_element_at(_map(first), kind), alone)


def section_of(kind: Column) -> Column:
    """struct<section, prefix, display> of a type; Other and the type itself if unknown."""
    known = {k: F.struct(F.lit(s).alias("section"), F.lit(p).alias("prefix"), F.lit(d).alias("display")) for s, p, kinds in SECTIONS for k, d in kinds.items()}
    return F.coalesce(F.try_element_at(_map(known), kind), F.struct(F.lit("Other").alias("section"), F.lit("OTHER").alias("prefix"), kind.alias("display")))


def section_rank(section: Column) -> Column:
    """The place of a section in a report, from 1."""
    return F.array_position(F.array(*map(F.lit, ORDER)), section).cast("int")


def text_of(kind: Column, which: int) -> Column:
    """Impact (0), prerequisites (1) or proof of impact (2) of a type, by its section."""
    return F.try_element_at(_map({p: t[which] for p, t in TEXTS.items()}), section_of(kind)["prefix"])


def impact(kind: Column) -> Column:
    return text_of(kind, 0)


def prerequisites(kind: Column) -> Column:
    return text_of(kind, 1)


def proof_of_impact(kind: Column) -> Column:
    return text_of(kind, 2)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def duration(ms: Column) -> Column:
    """``250ms``, ``1.5s`` or ``2m 5s``."""
    seconds = ms / 1000
    whole = F.floor(seconds)
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(
        F.format_string("%dm %ds", F.floor(whole / 60).cast("long"), (whole % 60).cast("long"))
    )


def url_encoded(text: Column) -> Column:
    """The few characters that matter in a shell, percent-encoded."""
    for plain, code in (("'", "%27"), (" ", "%20"), ("<", "%3C"), (">", "%3E"), (";", "%3B"), ("|", "%7C"), ("&", "%26")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def likely_endpoint(path: Column, kind: Column) -> Column:
    """A plausible route from a file's path and the type of what was found there."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    for folder in ("src/", "app/", "api/", "controllers/", "routes/", "handlers/"):
        path = F.when(F.instr(path, folder) > 0, F.substring(path, F.instr(path, folder) + len(folder), F.length(path))).otherwise(path)
    for ending in (".py", ".js", ".java", ".php", ".ts", ".go"):
        path = F.replace(path, F.lit(ending), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "__init__", "index", "main"))
    action = F.lit("")
    ends = (("sql", "search"), ("xss", "comment"), ("ssrf", "fetch"), ("command", "exec"), ("path", "download"), ("traversal", "download"), ("deserial", "import"), ("ssti", "preview"), ("auth", "profile"), ("idor", "profile"), ("redirect", "redirect"))
    for word, end in reversed(ends):
        action = F.when(F.lower(kind).contains(word), f"/{end}").otherwise(action)
    return F.when(F.size(parts) == 0, "/api/endpoint").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/"), action))


def likely_method(kind: Column, code: Column) -> Column:
    """POST, PUT, DELETE or GET from words of the code, else from the type."""
    code = F.lower(code)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: code.contains(w))
    return (
        F.when(has("post"), "POST").when(has("put"), "PUT").when(has("delete"), "DELETE").when(has("get", "request.args", "req.query"), "GET")
        .when(has("request.form", "req.body"), "POST").when(kind.isin("deserialization", "xxe", "ssti"), "POST").otherwise("GET")
    )


def variable_names(code: Column) -> Column:
    """Identifiers of a snippet in order, without keywords, calls and attributes."""
    words = F.regexp_extract_all(code, F.lit(r"(?<![\w.'\"])([A-Za-z_][A-Za-z0-9_]*)(?![\w'\"]|\s*\()"), F.lit(1))
    keywords = F.array(*map(F.lit, "def class return if else elif for while in not and or is None True False import from as with try except raise lambda var let const new function null true false this self public private static void int String".split()))
    return F.array_except(F.array_distinct(words), keywords)


def cwe_score(actual: Column, expected: Column) -> Column:
    """1 equal, 0.7 of one family, 0.3 both weaknesses, else 0."""
    a, b = F.trim(F.upper(actual)), F.trim(F.upper(expected))
    kin = F.lit(False)
    for family in FAMILIES:
        kin = kin | (a.isin(*family) & b.isin(*family))
    score = F.when(a == b, 1.0).when(kin, 0.7).when(a.startswith("CWE-") & b.startswith("CWE-"), 0.3).otherwise(0.0)
    return F.when((F.coalesce(actual, F.lit("")) == "") | (F.coalesce(expected, F.lit("")) == ""), 0.0).otherwise(score)


def type_score(actual: Column, expected: Column) -> Column:
    """1 equal, 0.5 if one holds the other, else 0."""
    a, b = F.lower(actual), F.lower(expected)
    return F.when(a == b, 1.0).when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), 0.5).otherwise(0.0)


def severity_score(distance: Column) -> Column:
    return _get({0: 1.0, 1: 0.8, 2: 0.5, 3: 0.2}, distance, 0.0)


def verdict_score(verdict: Column, negative: Column) -> Column:
    """Right verdicts count 1, undecided ones 0.5; a negative case is right when it is rejected."""
    right = F.when(negative, "rejected").otherwise("confirmed")
    return F.when(verdict == right, 1.0).when(verdict == "inconclusive", 0.5).otherwise(0.0)
