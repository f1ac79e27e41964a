"""JavaScript and Java sources: functions, classes, imports, calls, assignments and routes.

No grammar is needed: comments and strings are blanked out in place, then patterns find heads and
matching braces find their ends. Rows are those of the Python front end. Handled are named
functions, arrow functions bound to a name, methods, and the routes of Express, Spring and JAX-RS.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from graphlens.operators.graph import python_rows
from graphlens.sources.files import EXTRACTED, FIELDS

HIDDEN = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
HEADS = {
    "javascript": re.compile(
        r"\b(?:async\s+)?function\s*\*?\s*(?P<a>[A-Za-z_$][\w$]*)\s*\((?P<pa>[^()]*)\)\s*\{"
        r"|\b(?:const|let|var)\s+(?P<b>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b[^(]*)?\(?(?P<pb>[^()=;{}]*)\)?\s*(?:=>)?\s*\{"
        r"|(?<=[\s};{])(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(?:async\s+|static\s+)*(?P<c>[A-Za-z_$][\w$]*)\s*\((?P<pc>[^(){};]*)\)\s*\{"
    ),
    "java": re.compile(
        r"(?:(?:public|protected|private|static|final|synchronized|abstract|native|default)\s+)*(?:<[^<>]*>\s*)?(?!new\b|return\b|else\b|throw\b)[\w.$]+(?:<[^{};()]*>)?(?:\[\])*\s+"
        r"(?P<a>(?!if\b|for\b|while\b|switch\b|catch\b|try\b)[A-Za-z_$][\w$]*)\s*\((?P<pa>(?:[^(){};]|\([^()]*\))*)\)\s*(?:throws\s+[\w.,\s]+)?\{"
    ),
}
CLASS = re.compile(r"\b(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)(?:<[^{]*?>)?(?:\([^)]*\))?\s*(?:extends\s+([\w.$]+))?(?:<[^{]*?>)?\s*(?:implements\s+([\w.,\s$<>]+))?\s*\{")
IMPORTS = {
    "javascript": re.compile(r"\bimport\s+(?P<n>[^;'\"]*?)\s*(?:from\s*)?['\"](?P<m>[^'\"]+)['\"]|(?:const|let|var)\s+(?P<n2>[^=;]+?)\s*=\s*require\(\s*['\"](?P<m2>[^'\"]+)['\"]"),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<m>[\w.]+?)\.(?P<n>\w+|\*)\s*;", re.M),
}
CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\s*\.\s*)*)([A-Za-z_$][\w$]*)\s*\(")
ASSIGNED = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(?:[-+*/|&]|\|\||\?\?)?=(?![=>])\s*([^;\n]*)")
WORDS = set("if for while switch catch function return new typeof await super this throw else do try".split())
EXPRESS = re.compile(r"\b(\w*(?:app|router)\w*)\s*\.\s*(get|post|put|delete|patch|all|head|options)\s*\(\s*(['\"`])(.*?)\3\s*,(.*)", re.I)
SPRING = re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b\s*(?:\(((?:[^()]|\([^()]*\))*)\))?")
JAXRS = re.compile(r"@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b")
PATH = re.compile(r"@Path\s*\(\s*\"([^\"]*)\"")
GUARD = re.compile(r"@(PreAuthorize|PostAuthorize|Secured|RolesAllowed|DenyAll|Authenticated|RequiresPermissions|RequiresRoles|RequiresAuthentication)\b")
MIDDLEWARE = re.compile(r"auth|login|jwt|token|passport|session|protect|guard|permission|verify", re.I)
PARAMS = {
    "RequestParam": "query", "PathVariable": "path", "RequestBody": "body", "RequestHeader": "header", "CookieValue": "cookie", "RequestPart": "file", "ModelAttribute": "form",
    "QueryParam": "query", "PathParam": "path", "HeaderParam": "header", "CookieParam": "cookie", "FormParam": "form", "BeanParam": "form",
}


def blanked(text: str) -> str:
    """The text with comments and strings as spaces, line breaks kept, so places stay."""
    return HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int) -> int:
    """Where the brace that opens at ``at`` is closed, or the text's end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def merged(prefix: str, route: str) -> str:
    return "/" + "/".join(x for x in (prefix.strip("/"), route.strip("/")) if x)


def rows_of(path: str, content: str, language: str):
    bare = blanked(content)
    line = lambda at: content.count("\n", 0, at) + 1
    spans = []  # (start, end, qualified name)
    for m in CLASS.finditer(bare):
        end = closing(bare, m.end() - 1)
        bases = ",".join(x.strip() for x in ((m[2] or "") + "," + (m[3] or "")).split(",") if x.strip())
        spans.append((m.start(), end, m[1], True, m.start()))
        yield path, "class", m[1], line(m.start()), line(end), "", bases
    for m in HEADS[language].finditer(bare):
        which = next(k for k in ("a", "b", "c") if k in m.groupdict() and m[k])
        name, given = m[which], m["p" + which] or ""
        if name in WORDS:
            continue
        start, end = m.start(which), closing(bare, m.end() - 1)
        spans.append((start, end, name, False, m.start()))
    spans.sort()

    def owner(at: int, classes: bool = True) -> str:
        return ".".join(s[2] for s in spans if s[0] <= at <= s[1] and (classes or not s[3]))

    for start, end, name, is_class, head in spans:
        if is_class:
            continue
        given = content[bare.index("(", start) + 1 :] if "(" in bare[start:end] else ""
        depth, k = 1, 0
        while k < len(given) and depth:
            depth += {"(": 1, ")": -1}.get(given[k], 0)
            k += 1
        args = [a.strip() for a in re.split(r",(?![^<(]*[>)])", given[: max(0, k - 1)]) if a.strip()]
        names = [re.sub(r"[=:].*", "", a, flags=re.S).split()[-1].lstrip(".") if re.sub(r"[=:].*", "", a, flags=re.S).split() else a for a in args]
        around = owner(start - 1)
        yield path, "function", name, line(start), line(end), around, ",".join(names)
        inner = f"{around}.{name}" if around else name
        for i, (arg, whole) in enumerate(zip(names, args, strict=True)):
            yield path, "parameter", arg, line(start), line(start), inner, str(i)
            if language == "java" and (mark := re.match(r"@(\w+)", whole)) and mark[1] in PARAMS:
                yield path, "route_param", arg, line(start), line(start), name, PARAMS[mark[1]]
        if language == "java":
            yield from annotated(path, content, bare, spans, start, head, name, line)
    for m in IMPORTS[language].finditer(content):
        module = m["m"] or m.groupdict().get("m2")
        for n in re.findall(r"[\w$*]+", m["n"] or m.groupdict().get("n2") or "") or [""]:
            if n not in ("as", "default"):
                yield path, "import", module, line(m.start()), line(m.start()), "", n
    heads = {s[0] for s in spans}
    for m in CALL.finditer(bare):
        if m[2] not in WORDS and m.start(2) not in heads:
            text = content[m.start() : m.start() + 200].split("\n")[0]
            yield path, "call", m[2], line(m.start()), line(m.start()), owner(m.start()), text
    for m in ASSIGNED.finditer(bare):
        yield path, "assignment", m[1], line(m.start()), line(m.start()), owner(m.start()), content[m.start() : m.end()][:120]
    if language == "javascript":
        for m in EXPRESS.finditer(content):
            if bare[m.start()].isspace():
                continue
            rest = [x.strip() for x in m[5].split(",")]
            handler = re.match(r"[\w$.]+", rest[-1].rstrip(");")) if not re.search(r"=>|function", m[5]) else None
            name = handler[0] if handler else f"handler_{line(m.start())}"
            yield path, "route", m[4], line(m.start()), line(m.start()), name, "ANY" if m[2].lower() == "all" else m[2].upper()
            for p in re.findall(r":(\w+)", m[4]):
                yield path, "route_param", p, line(m.start()), line(m.start()), name, "path"
            before = re.split(r"=>|function", m[5])[0].rsplit(",", 1)[0] if "," in m[5] else ""
            if MIDDLEWARE.search(before):
                yield path, "route_auth", before.strip()[:80], line(m.start()), line(m.start()), name, "middleware"


def annotated(path, content, bare, spans, start, head, name, line):
    """Routes and guards of a Java method, from the annotations before it and before its class."""
    before = content[max(bare.rfind(c, 0, head) for c in ";{}") + 1 : start]
    holder = [s for s in spans if s[3] and s[0] <= start <= s[1]]
    above = content[max(bare.rfind(c, 0, holder[-1][4]) for c in ";}") + 1 : holder[-1][0]] if holder else ""
    first = lambda text: next(iter(re.findall(r"\"([^\"]*)\"", text or "")), "")
    found = []
    base = SPRING.search(above)
    for m in SPRING.finditer(before):
        verbs = [m[1].upper()] if m[1] != "Request" else re.findall(r"RequestMethod\.(\w+)", m[2] or "") or ["ANY"]
        found += [(merged(first(base[2]) if base else "", first(m[2])), v) for v in verbs]
    if not found:
        prefix, own = PATH.search(above), PATH.search(before)
        found = [(merged(prefix[1] if prefix else "", own[1] if own else ""), m[1]) for m in JAXRS.finditer(before)]
    for route, verb in found:
        yield path, "route", route, line(start), line(start), name, verb
    if found and (mark := GUARD.search(before) or GUARD.search(above)):
        yield path, "route_auth", mark[1], line(start), line(start), name, "annotation"


def javascript_facts(path: str, content: str):
    yield from rows_of(path, content, "javascript")


def java_facts(path: str, content: str):
    yield from rows_of(path, content, "java")


def extract(files: DataFrame) -> DataFrame:
    """Facts of the JavaScript and Java files among (path, language, content)."""
    script = python_rows(files.where("language = 'javascript'"), javascript_facts, EXTRACTED, FIELDS)
    return script.unionByName(python_rows(files.where("language = 'java'"), java_facts, EXTRACTED, FIELDS))
