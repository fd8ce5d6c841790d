"""Prompt templates for batch inference and parsing of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: prompt texts ------------------------------------------------
SECURITY_SYSTEM = (
    "You are a security expert analyzing code for vulnerabilities.\n"
    "Your task is to identify security issues and provide actionable recommendations.\n"
    "Be specific about the vulnerability type, location, and remediation steps."
)
PERFORMANCE_SYSTEM = (
    "You are a performance optimization expert analyzing code.\n"
    "Your task is to identify performance bottlenecks and suggest optimizations.\n"
    "Focus on algorithmic complexity, resource usage, and best practices."
)
TEMPLATES = {
    "security": """Analyze the following {language} code for security vulnerabilities:

```{language}
{code}
```

Identify any security issues and provide:
1. Vulnerability type (e.g., SQL injection, XSS, command injection)
2. Severity (Critical, High, Medium, Low)
3. Line numbers where the issue occurs
4. Explanation of the vulnerability
5. Suggested fix with code example

Format your response as JSON:
{
    "vulnerabilities": [
        {
            "type": "vulnerability type",
            "severity": "severity level",
            "line": line number,
            "description": "explanation",
            "fix": "suggested fix"
        }
    ],
    "summary": "brief summary"
}""",
    "fix": """Fix the following {vulnerability_type} vulnerability in this {language} code:

```{language}
{code}
```

Provide:
1. The fixed code
2. Explanation of what was changed
3. Why the fix works

Format as JSON:
{
    "fixed_code": "the complete fixed code",
    "explanation": "explanation of changes",
    "best_practices": "additional recommendations"
}""",
    "explain": """Explain the {vulnerability_type} vulnerability{cwe_suffix} in detail:

Provide:
1. What the vulnerability is
2. Common attack scenarios
3. How to prevent it
4. Code examples of vulnerable and secure code
""",
    "performance": """Analyze the following {language} code for performance issues:

```{language}
{code}
```

Identify:
1. Algorithmic complexity issues (O(n^2), O(2^n), etc.)
2. Inefficient data structure usage
3. Memory allocation issues
4. I/O bottlenecks
5. Caching opportunities
6. Concurrency possibilities

For each issue provide:
- Location (line numbers)
- Current complexity
- Suggested improvement
- Expected performance gain

Format as JSON:
{
    "issues": [
        {
            "type": "issue type",
            "location": "line numbers",
            "severity": "high/medium/low",
            "current_complexity": "O(n)",
            "suggested_complexity": "O(log n)",
            "description": "explanation",
            "optimization": "suggested code"
        }
    ],
    "overall_score": 0-100,
    "summary": "brief summary"
}""",
    "optimize": """Optimize the following {language} code for {target_metric}:

```{language}
{code}
```

Provide:
1. Optimized code
2. Explanation of changes
3. Expected improvement percentage
4. Trade-offs (if any)

Format as JSON:
{
    "optimized_code": "the optimized code",
    "explanation": "detailed explanation",
    "expected_improvement": "e.g., 50% faster",
    "trade_offs": "any trade-offs made"
}""",
    "complexity": """Analyze the time and space complexity of this {language} code:

```{language}
{code}
```

Provide:
1. Time complexity (Big O notation)
2. Space complexity (Big O notation)
3. Best case scenario
4. Worst case scenario
5. Bottleneck identification

Format as JSON:
{
    "time_complexity": "O(n)",
    "space_complexity": "O(1)",
    "best_case": "description",
    "worst_case": "description",
    "bottlenecks": ["list of bottlenecks"]
}""",
    "general": """Analyze the following {language} code and provide insights:

```{language}
{code}
```

Provide:
1. Brief explanation of what the code does
2. Potential issues or improvements
3. Best practices that could be applied
""",
}
SYSTEM_OF = {
    "security": SECURITY_SYSTEM, "fix": SECURITY_SYSTEM, "explain": SECURITY_SYSTEM,
    "performance": PERFORMANCE_SYSTEM, "optimize": PERFORMANCE_SYSTEM,
    "complexity": PERFORMANCE_SYSTEM,
}
COMPLETION_STOPS = ["\n\n", "\ndef ", "\nclass "]
# --- end of fixed values ---------------------------------------------------------


def fill(template: str, **values: Column) -> Column:
    """Concatenate a template's literal parts and the given columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{%s}" % name), name) for name in values if "{%s}" % name in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


def wrap(system: str, user: Column) -> Column:
    """System and user prompt in instruction form."""
    return F.concat(
        F.lit(f"<s>[INST] <<SYS>>\n{system}\n<</SYS>>\n\n"), user, F.lit(" [/INST]")
    )


def analysis_prompt(kind: str, code: Column, language: Column, **extra: Column) -> Column:
    """Prompt column of one kind (see TEMPLATES)."""
    if kind == "explain":
        cwe = extra.get("cwe_id", F.lit(None).cast("string"))
        extra = {
            "vulnerability_type": extra["vulnerability_type"],
            "cwe_suffix": F.when(
                F.coalesce(cwe, F.lit("")) != "", F.concat(F.lit(" (CWE-"), cwe, F.lit(")"))
            ).otherwise(F.lit("")),
        }
        body = fill(TEMPLATES[kind], **extra)
    else:
        body = fill(TEMPLATES[kind], code=code, language=language, **extra)
    return wrap(SYSTEM_OF[kind], body) if kind in SYSTEM_OF else body


def completion_prompt(prefix: Column, suffix: Column) -> Column:
    """Fill-in-the-middle form when there is a suffix, else the prefix."""
    return F.when(
        F.coalesce(suffix, F.lit("")) != "",
        F.concat(
            F.lit("<fim_prefix>"), prefix, F.lit("<fim_suffix>"), suffix, F.lit("<fim_middle>")
        ),
    ).otherwise(prefix)


FENCED = r"(?s)```json\n(.*?)\n```"
OUTPUT_SCHEMAS = {
    "security": "vulnerabilities array<struct<type:string,severity:string,line:int,"
                "description:string,fix:string>>, summary string, raw_response string",
    "performance": "issues array<struct<type:string,location:string,severity:string,"
                   "current_complexity:string,suggested_complexity:string,description:string,"
                   "optimization:string>>, overall_score int, summary string, "
                   "raw_response string",
    "fix": "fixed_code string, explanation string, best_practices string",
    "optimize": "optimized_code string, explanation string, expected_improvement string, "
                "trade_offs string",
    "complexity": "time_complexity string, space_complexity string, best_case string, "
                  "worst_case string, bottlenecks array<string>, raw_analysis string",
}
RAW_FIELD = {
    "security": "raw_response", "performance": "raw_response", "fix": "fixed_code",
    "optimize": "optimized_code", "complexity": "raw_analysis",
}


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object (checked by the JVM's JSON parser)."""
    return text.isNotNull() & F.json_object_keys(F.trim(text)).isNotNull()


def json_text(text: Column, fenced: bool = True) -> Column:
    """The JSON object in a model's answer, or NULL.

    The whole text if it parses, else the first fenced json block.
    """
    whole = F.when(is_object(text), text)
    if not fenced:
        return whole
    block = F.regexp_extract(text, FENCED, 1)
    return F.coalesce(whole, F.when(is_object(block), block))


def parse_output(text: Column, kind: str) -> Column:
    """Struct of a kind's answer; unparsable text goes to its raw field."""
    found = json_text(text, fenced=kind != "complexity")
    parsed = F.from_json(found, OUTPUT_SCHEMAS[kind])
    raw = RAW_FIELD[kind]
    wrapped = F.from_json(
        F.to_json(F.struct(text.alias(raw))), OUTPUT_SCHEMAS[kind]
    )
    return F.when(found.isNotNull(), parsed).otherwise(wrapped)


def items_found(parsed: Column, kind: str) -> Column:
    field = "vulnerabilities" if kind == "security" else "issues"
    return F.coalesce(F.size(F.coalesce(parsed[field], F.array())), F.lit(0))


def overall_score(parsed: Column) -> Column:
    return F.coalesce(parsed["overall_score"], F.lit(50))
