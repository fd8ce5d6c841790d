"""Rule catalogs, taint catalogs, language tables, lookups.

Everything here is data.  Operators receive these tables as arguments, so a
user can pass their own.  Tables are small and closed (well under 200 rows
each), which is what makes unrolling them into expressions, or broadcasting
them, safe at any data size.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: severities, in order of rank (highest first) -------------
SEVERITIES = ("critical", "high", "medium", "low", "info")

# --- fixed values: characters Python's str.strip() removes ------------------
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)


@dataclass(frozen=True)
class LineRule:
    """A regex applied to single lines (or to a window of 2-3 lines).

    ``gate`` is a literal that every match must contain; testing it first is a
    cheap substring search that spares most lines the regex.  Security rules
    ignore case and report every match; performance rules report a line once.
    """

    rule_id: str
    name: str
    severity: str
    message: str
    remediation: str
    languages: tuple[str, ...]
    pattern: str
    gate: str
    confidence: str | None = None
    cwe_id: str | None = None
    window: int = 1
    kind: str = "security"


# --- fixed values: security rules (case-insensitive) ------------------------
SECURITY_RULES = (
    LineRule(
        "CS-S001", "SQL Injection Risk", "high",
        "Potential SQL injection vulnerability detected",
        "Use parameterized queries instead of string formatting",
        ("python",), r"""(?:execute|query|cursor\.execute)\s*\(\s*["'].*%s""", "%",
        "medium", "CWE-89",
    ),
    LineRule(
        "CS-S002", "Hardcoded Secret", "high",
        "Potential hardcoded secret detected",
        "Use environment variables or a secrets manager",
        ("*",), r"""(?:password|secret|token|key|api_key)\s*=\s*["'][^"']{8,}["']""", "=",
        "low", "CWE-798",
    ),
    LineRule(
        "CS-S003", "Insecure Deserialization", "critical",
        "Insecure deserialization detected",
        "Use safe alternatives like json.loads or yaml.safe_load",
        ("python",), r"(?:pickle\.loads|yaml\.load|eval|exec)\s*\(", "(",
        "high", "CWE-502",
    ),
    LineRule(
        "CS-S004", "Command Injection Risk", "critical",
        "Potential command injection vulnerability",
        "Use subprocess with list arguments instead of shell=True",
        ("python",), r"(?:os\.system|subprocess\.call|subprocess\.Popen)\s*\([^)]*%", "%",
        "medium", "CWE-78",
    ),
    LineRule(
        "CS-S005", "Weak Cryptography", "medium",
        "Use of weak cryptographic algorithm",
        "Use SHA-256 or stronger hashing algorithms",
        ("python", "javascript", "java"), r"(?:md5|sha1)\s*\(", "(",
        "medium", "CWE-328",
    ),
    LineRule(
        "CS-S006", "Debug Mode Enabled", "medium",
        "Debug mode should not be enabled in production",
        "Set DEBUG = False in production configuration",
        ("python",), r"DEBUG\s*=\s*True", "=",
        "high", "CWE-489",
    ),
    LineRule(
        "CS-S007", "XSS Vulnerability", "high",
        "Potential XSS vulnerability",
        "Use textContent or sanitize user input before DOM insertion",
        ("javascript",), r"(?:innerHTML|outerHTML|document\.write)\s*=\s*", "=",
        "medium", "CWE-79",
    ),
    LineRule(
        "CS-S008", "Insecure CORS", "low",
        "Permissive CORS policy detected",
        "Specify explicit allowed origins instead of wildcard",
        ("*",), r"Access-Control-Allow-Origin.*\*", "*",
        "high", "CWE-942",
    ),
)

# --- fixed values: performance rules (case-sensitive) -----------------------
# PERF-P005 is written with one word character on each side of the dot: a
# longer `word.word` repeats on three lines exactly when its `c.d` core does,
# and the short form cannot backtrack over long words.
_JS = ("javascript", "typescript")
PERFORMANCE_RULES = (
    LineRule(
        "PERF-P001", "Inefficient List Concatenation", "medium",
        "Using '+' to concatenate lists is inefficient (O(n^2))",
        "Use list.append() or list.extend() instead",
        ("python",), r"\+\s*\[", "[",
        kind="performance",
    ),
    LineRule(
        "PERF-P002", "String Concatenation in Loop", "medium",
        "String concatenation in a loop is inefficient",
        "Use str.join() or io.StringIO instead",
        ("python",), r"for.*:\s*\n.*\+\s*=", "for", window=2,
        kind="performance",
    ),
    LineRule(
        "PERF-P003", "Inefficient Dictionary Lookup", "low",
        "Using .keys() for membership testing is inefficient",
        "Use 'key in dict' instead of 'key in dict.keys()'",
        ("python",), r"\.keys\(\)\s*.*in", ".keys()",
        kind="performance",
    ),
    LineRule(
        "PERF-P004", "List Comprehension Alternative", "low",
        "Consider using list comprehension for better performance",
        "Replace loop with list comprehension",
        ("python",), r"for\s+\w+\s+in\s+\w+:\s*\n\s*\w+\.append\(", "for", window=2,
        kind="performance",
    ),
    LineRule(
        "PERF-P005", "Repeated Attribute Access", "low",
        "Repeated attribute access in loop can be slow",
        "Cache the attribute in a local variable",
        ("python",), r"(\w\.\w).*\n.*\1.*\n.*\1", ".", window=3,
        kind="performance",
    ),
    LineRule(
        "PERF-J001", "Inefficient DOM Access", "medium",
        "Repeated DOM access can be slow",
        "Cache DOM references in variables",
        _JS, r"document\.getElementById|document\.querySelector", "document.",
        kind="performance",
    ),
    LineRule(
        "PERF-J002", "console.log in Production", "low",
        "Console statements can slow down performance",
        "Remove console statements in production code",
        _JS, r"console\.(log|debug|info)\(", "console.",
        kind="performance",
    ),
    LineRule(
        "PERF-J003", "Inefficient Loop", "low",
        "Accessing .length on each iteration is inefficient",
        "Cache the length: for (var i = 0, len = arr.length; i < len; i++)",
        _JS, r"for\s*\(\s*var\s+i\s*=\s*0;\s*i\s*<\s*\w+\.length", ".length",
        kind="performance",
    ),
)

# --- fixed values: function-level performance rules -------------------------
COMPLEXITY_HIGH = 50
COMPLEXITY_MEDIUM = 20
MAX_FUNCTION_SPAN = 100
MAX_NESTING = 4

# --- fixed values: functions whose definition is reported (CS-AST001) -------
DANGEROUS_FUNCTIONS = {
    "python": ("eval", "exec", "compile", "__import__"),
    "javascript": ("eval", "Function", "setTimeout", "setInterval"),
    "java": ("Runtime.exec", "ProcessBuilder"),
}

# --- fixed values: OWASP categories and the CWE mapping ---------------------
OWASP_TITLES = {
    "A01": "Broken Access Control",
    "A02": "Cryptographic Failures",
    "A03": "Injection",
    "A04": "Insecure Design",
    "A05": "Security Misconfiguration",
    "A06": "Vulnerable and Outdated Components",
    "A07": "Identification and Authentication Failures",
    "A08": "Software and Data Integrity Failures",
    "A09": "Security Logging and Monitoring Failures",
    "A10": "Server-Side Request Forgery",
}
CWE_TO_OWASP = {
    "CWE-89": "A03",
    "CWE-78": "A03",
    "CWE-79": "A03",
    "CWE-94": "A03",
    "CWE-22": "A01",
    "CWE-312": "A02",
    "CWE-798": "A07",
    "CWE-307": "A07",
    "CWE-502": "A08",
    "CWE-918": "A10",
}

# --- fixed values: taint sources (pattern, level, type) ---------------------
TAINT_SOURCES = {
    "python": (
        ("request.args.get", "high", "http_parameter"),
        ("request.form.get", "high", "http_parameter"),
        ("request.json", "high", "http_body"),
        ("request.headers.get", "medium", "http_header"),
        ("input", "high", "user_input"),
        ("sys.argv", "medium", "command_line"),
        ("os.environ.get", "low", "environment"),
        ("file.read", "medium", "file_read"),
        ("socket.recv", "high", "network"),
    ),
    "javascript": (
        ("req.query", "high", "http_parameter"),
        ("req.body", "high", "http_body"),
        ("req.params", "high", "http_parameter"),
        ("req.headers", "medium", "http_header"),
        ("window.location.href", "high", "url_parameter"),
        ("document.cookie", "medium", "cookie"),
        ("localStorage.getItem", "medium", "storage"),
        ("prompt", "high", "user_input"),
        ("fetch", "medium", "network"),
    ),
    "java": (
        ("request.getParameter", "high", "http_parameter"),
        ("request.getHeader", "medium", "http_header"),
        ("System.getenv", "low", "environment"),
        ("Scanner.nextLine", "high", "user_input"),
        ("BufferedReader.readLine", "medium", "file_read"),
    ),
}

# --- fixed values: taint sinks (pattern, type, required level) --------------
TAINT_SINKS = {
    "python": (
        ("cursor.execute", "sql", "low"),
        ("execute", "sql", "low"),
        ("eval", "code_execution", "critical"),
        ("exec", "code_execution", "critical"),
        ("os.system", "command", "low"),
        ("subprocess.call", "command", "low"),
        ("subprocess.Popen", "command", "low"),
        ("render_template_string", "xss", "low"),
        ("open", "file_write", "medium"),
        ("pickle.loads", "deserialization", "critical"),
        ("yaml.load", "deserialization", "high"),
    ),
    "javascript": (
        ("eval", "code_execution", "critical"),
        ("Function", "code_execution", "critical"),
        ("exec", "command", "low"),
        ("innerHTML", "xss", "low"),
        ("document.write", "xss", "low"),
        ("window.location", "open_redirect", "medium"),
        ("fs.writeFile", "file_write", "medium"),
    ),
    "java": (
        ("Statement.execute", "sql", "low"),
        ("Runtime.exec", "command", "low"),
        ("ProcessBuilder", "command", "low"),
        ("ObjectInputStream.readObject", "deserialization", "critical"),
        ("ScriptEngine.eval", "code_execution", "critical"),
    ),
}

# --- fixed values: sanitizers -----------------------------------------------
SANITIZERS = {
    "python": (
        "escape", "html.escape", "bleach.clean", "re.escape",
        "shlex.quote", "int", "float", "str.encode",
    ),
    "javascript": (
        "encodeURIComponent", "encodeURI", "escapeHtml", "DOMPurify.sanitize", "he.encode",
    ),
    "java": ("HtmlUtils.htmlEscape", "URLEncoder.encode", "PreparedStatement"),
}

# --- fixed values: sink type -> (vulnerability, CWE, remediation) -----------
SINK_FINDINGS = {
    "sql": ("SQL Injection", "CWE-89", "Use parameterized queries or prepared statements"),
    "command": ("Command Injection", "CWE-78", "Avoid shell execution; use list-based arguments"),
    "code_execution": (
        "Code Injection", "CWE-94", "Avoid dynamic code execution; use safer alternatives"),
    "xss": ("Cross-Site Scripting", "CWE-79", "Encode output before rendering in HTML"),
    "deserialization": (
        "Insecure Deserialization", "CWE-502",
        "Use safe deserialization methods; validate input"),
    "file_write": ("Path Traversal", "CWE-22", "Validate and sanitize file paths"),
    "open_redirect": ("Open Redirect", "CWE-601", "Validate redirect URLs against allowlist"),
}
DEFAULT_SINK_FINDING = ("Taint Flow", "CWE-20", "Validate and sanitize all user input")

# --- fixed values: language tables ------------------------------------------
# "scanner": what the scanners recognise; first match in this order wins.
SCANNER_LANGUAGES = {
    "python": (".py",),
    "javascript": (".js", ".jsx", ".mjs"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "go": (".go",),
    "rust": (".rs",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".h"),
    "c": (".c", ".h"),
    "csharp": (".cs",),
    "php": (".php",),
    "ruby": (".rb",),
}
# "extended": for inventories; also matches bare file names.
EXTENDED_LANGUAGES = {
    "python": (".py", ".pyw", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "java": (".java",),
    "go": (".go",),
    "rust": (".rs",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh"),
    "c": (".c", ".h"),
    "csharp": (".cs",),
    "php": (".php", ".phtml"),
    "ruby": (".rb", ".erb"),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "scala": (".scala",),
    "r": (".r", ".R"),
    "matlab": (".m",),
    "sql": (".sql",),
    "shell": (".sh", ".bash", ".zsh"),
    "powershell": (".ps1",),
    "yaml": (".yaml", ".yml"),
    "json": (".json",),
    "xml": (".xml",),
    "html": (".html", ".htm"),
    "css": (".css", ".scss", ".sass", ".less"),
    "markdown": (".md", ".markdown"),
    "dockerfile": ("Dockerfile",),
    "makefile": ("Makefile", ".mk"),
}
# "listing": the supported-language listing shown to users.
LISTED_LANGUAGES = (
    ("python", "Python", (".py",)),
    ("javascript", "JavaScript", (".js", ".jsx")),
    ("typescript", "TypeScript", (".ts", ".tsx")),
    ("java", "Java", (".java",)),
    ("go", "Go", (".go",)),
    ("rust", "Rust", (".rs",)),
    ("cpp", "C++", (".cpp", ".cc", ".hpp")),
    ("c", "C", (".c", ".h")),
    ("csharp", "C#", (".cs",)),
    ("php", "PHP", (".php",)),
    ("ruby", "Ruby", (".rb",)),
    ("swift", "Swift", (".swift",)),
)
# Languages the structure extractor understands.
PARSED_LANGUAGES = ("python", "javascript", "java", "go", "rust", "cpp")

# --- fixed values: comment styles used by code normalisation ----------------
HASH_COMMENT_LANGUAGES = ("python", "yaml", "shell", "ruby", "perl")
SLASH_COMMENT_LANGUAGES = (
    "javascript", "typescript", "java", "cpp", "c", "go", "rust", "swift",
)

# --- fixed values: rule listing shown to users ------------------------------
LISTED_RULES = (
    ("sql-injection", "SQL Injection Detection", "security",
     ("python", "javascript", "java", "php"), "high",
     "Detects potential SQL injection vulnerabilities"),
    ("xss-detection", "XSS Detection", "security",
     ("javascript", "php", "python"), "high",
     "Detects potential cross-site scripting vulnerabilities"),
    ("inefficient-loop", "Inefficient Loop Pattern", "performance",
     ("python", "javascript"), "medium",
     "Detects inefficient patterns in loops"),
    ("complex-function", "Overly Complex Function", "quality",
     ("*",), "low",
     "Detects functions with high cyclomatic complexity"),
)

# --- fixed values: external scanner severities ------------------------------
EXTERNAL_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}

# --- fixed values: request limiting -----------------------------------------
EXEMPT_PATHS = ("/health", "/ready", "/live", "/metrics")
RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 60

# --- fixed values: file limits ----------------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FILES_PER_REPO = 1000
SKIPPED_DIRECTORIES = ("node_modules", "__pycache__")

# --- fixed values: duration histogram buckets (seconds) ---------------------
DURATION_BUCKETS = (1, 5, 10, 30, 60, 120, 300, 600)

# --- fixed values: zero-filled summary keys ---------------------------------
SUMMARY_SEVERITIES = ("high", "medium", "low", "info")
SUMMARY_TYPES = ("security", "performance", "quality")

# --- fixed values: job life cycle -------------------------------------------
JOB_STATUSES = ("pending", "queued", "running", "completed", "failed", "cancelled")
TERMINAL_STATUSES = ("completed", "failed", "cancelled")
