"""Next.js checks: exposed environment names, open API routes, unvalidated actions, raw HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.functions.text import numbered_lines, strip
from codeaudit.model import emit, finding
from codeaudit.sources.files import SKIP_HTML, only_tracked

# --- fixed values -----------------------------------------------------------
CONFIG_FILES = ["next.config.js", "next.config.ts", "next.config.mjs"]
SENSITIVE = (r"(?i)(SECRET|PASSWORD|API_KEY|PRIVATE_KEY|TOKEN|DATABASE_URL|DB_URL|STRIPE_SECRET|"
             r"AWS_SECRET|OPENAI_API|ANTHROPIC_API|GEMINI_API|AUTH_SECRET|JWT_SECRET|"
             r"ENCRYPTION_KEY|SUPABASE_SERVICE_ROLE)")
AUTH = (r"(?i)getServerSession|getSession|auth\(\)|currentUser|getToken|verifyToken|jwt\.verify|"
        r"requireAuth|withAuth|isAuthenticated|middleware|NextAuth|clerk|supabase\.auth|getAuth")
VALIDATION = (r"(?i)\.parse\(|\.safeParse\(|\.validate\(|\.validateSync\(|typeof\s+\w+\s*[!=]==|"
              r"if\s*\(\s*!\s*\w+|assert\(|sanitize|escape\(|DOMPurify")
SERVER_ACTION = r"['\"]use server['\"]"
API_ROOTS = r"^(?:src/)?(?:pages|app)/api/"
ACTION_ROOTS = r"^(?:src/)?(?:app|actions)/"
OPEN_BY_DESIGN = r"health|status|ping|webhook"
SCRIPT_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx"]
# ----------------------------------------------------------------------------

ANALYZER = {"analyzer": "nextjs", "category": "framework_specific", "tool": "nextjs-checker"}


def next_repos(files: DataFrame) -> DataFrame:
    """Repositories with a Next.js configuration or dependency at their root."""
    sections = ["dependencies", "devDependencies"]
    parsed = F.from_json("content", ", ".join(f"`{s}` map<string,string>" for s in sections))
    depends = F.lit(False)
    for s in sections:
        depends = depends | F.coalesce(F.map_contains_key(parsed[s], "next"), F.lit(False))
    is_config = F.col("path").isin(CONFIG_FILES)
    return (files.filter(is_config | ((F.col("path") == "package.json") & depends))
            .select("repo_id").distinct())


def _script() -> Column:
    return F.col("ext").isin(SCRIPT_EXTENSIONS)


def env_exposure() -> Column:
    """Sensitive names with the public prefix in the root's .env files, one finding per line."""
    path, content = F.col("path"), F.col("content")
    named = F.transform(numbered_lines(content), lambda n: F.struct(
        n["line_no"].alias("line_no"), strip(n["text"]).alias("text")))
    named = F.transform(
        F.filter(named, lambda n: ~n["text"].startswith("#") & n["text"].contains("=")),
        lambda n: F.struct(n["line_no"].alias("line_no"),
                           strip(F.split_part(n["text"], F.lit("="), F.lit(1))).alias("name")))
    exposed = F.filter(named, lambda n: n["name"].startswith("NEXT_PUBLIC_")
                       & n["name"].rlike(SENSITIVE))

    def found(n: Column) -> Column:
        name = n["name"]
        return finding(
            **ANALYZER, ord=1, severity="critical", file=path, line=n["line_no"],
            title=F.concat(F.lit("Secret Exposed to Client: "), name),
            description=F.concat(
                F.lit("Environment variable '"), name,
                F.lit("' has the NEXT_PUBLIC_ prefix, which exposes it to the browser. This "
                      "variable appears to contain sensitive data that should never reach the "
                      "client.")),
            remediation=F.concat(
                F.lit("Remove the NEXT_PUBLIC_ prefix from '"), name,
                F.lit("'. Access it only in server-side code (API routes, getServerSideProps, "
                      "Server Components).")),
            ai_prompt=F.concat(
                F.lit("The env var '"), name,
                F.lit("' is prefixed with NEXT_PUBLIC_ which exposes it to the browser. Remove "
                      "the prefix and refactor the code to only access this var on the server "
                      "side.")),
            evidence=F.concat(F.lit("Line "), n["line_no"], F.lit(": "), name, F.lit("=...")))

    gate = path.rlike(r"^\.env[^/]*$") & content.contains("NEXT_PUBLIC_")
    return F.when(gate, F.transform(exposed, found))


def open_route() -> Column:
    """An API route file without any sign of authentication."""
    path = F.col("path")
    gate = (_script() & path.rlike(API_ROOTS) & ~F.lower(path).rlike(OPEN_BY_DESIGN)
            & ~F.col("content").rlike(AUTH))
    return F.when(gate, F.array(finding(
        **ANALYZER, ord=2, severity="high", file=path,
        title=F.concat(F.lit("Unprotected API Route: "), path),
        description=F.concat(
            F.lit("API route '"), path,
            F.lit("' has no authentication check. Any user (or bot) can call this endpoint. This "
                  "is a common mistake in vibe-coded Next.js apps.")),
        remediation="Add authentication to this route using getServerSession(), NextAuth, Clerk, "
                    "or your auth library. Return 401 for unauthenticated requests.",
        ai_prompt=F.concat(
            F.lit("Add authentication to "), path,
            F.lit(". Use getServerSession or equivalent to verify the user is logged in before "
                  "processing the request.")),
        evidence="No auth pattern found (getServerSession, verifyToken, withAuth, etc.)")))


def unvalidated_action() -> Column:
    """A server-action file without any sign of input validation."""
    path, content = F.col("path"), F.col("content")
    gate = (_script() & path.rlike(ACTION_ROOTS) & content.rlike(SERVER_ACTION)
            & ~content.rlike(VALIDATION))
    return F.when(gate, F.array(finding(
        **ANALYZER, ord=3, severity="high", file=path,
        title=F.concat(F.lit("Unvalidated Server Action: "), path),
        description=F.concat(
            F.lit("Server action in '"), path,
            F.lit("' contains 'use server' but has no input validation (no zod .parse(), "
                  "joi.validate(), etc.). Server actions receive raw user input from the "
                  "client.")),
        remediation="Add input validation using zod, yup, or joi. Parse and validate all inputs "
                    "before processing.",
        ai_prompt=F.concat(
            F.lit("Add zod schema validation to the server action in "), path,
            F.lit(". Define a schema for the expected input shape and call .parse() on it.")),
        evidence="'use server' directive found but no validation pattern detected")))


def raw_html() -> Column:
    """The first raw-HTML line of a script that does not sanitize."""
    content, path = F.col("content"), F.col("path")
    gate = (_script() & content.contains("dangerouslySetInnerHTML")
            & ~content.contains("DOMPurify") & ~F.lower(content).contains("sanitize"))
    first = F.slice(F.filter(numbered_lines(content), lambda n: n["text"].contains(
        "dangerouslySetInnerHTML")), 1, 1)
    return F.when(gate, F.transform(first, lambda n: finding(
        **ANALYZER, ord=4, severity="high", file=path, line=n["line_no"],
        title="Unsanitized dangerouslySetInnerHTML",
        description="dangerouslySetInnerHTML is used without DOMPurify or sanitization. This "
                    "enables XSS if the content comes from user input or an LLM.",
        remediation="Install DOMPurify and sanitize the HTML: dangerouslySetInnerHTML={{ __html: "
                    "DOMPurify.sanitize(content) }}",
        ai_prompt=F.concat(
            F.lit("Add DOMPurify sanitization to the dangerouslySetInnerHTML in "), path,
            F.lit(" at line "), n["line_no"], F.lit(".")),
        evidence=F.concat(F.lit("Line "), n["line_no"], F.lit(": "),
                          F.left(strip(n["text"]), F.lit(100))))))


def next_checks() -> list[Column]:
    return [env_exposure(), open_route(), unvalidated_action(), raw_html()]


def in_next_scope(findings: DataFrame, files: DataFrame, tracked: DataFrame | None = None,
                  git_repos: DataFrame | None = None) -> DataFrame:
    """Findings of tracked files in Next.js repositories. The filters apply to findings, so no
    file content takes part in a join."""
    vendored = F.lit(False)  # left out of the raw-HTML check only
    for name in SKIP_HTML:
        vendored = vendored | F.col("path").contains(name)
    kept = only_tracked(findings.withColumn("path", F.col("file")), tracked, git_repos,
                        ~(vendored & (F.col("ord") == 4)))
    return kept.drop("path").join(next_repos(files), "repo_id", "left_semi")


def next_findings(files: DataFrame, tracked: DataFrame | None = None,
                  git_repos: DataFrame | None = None) -> DataFrame:
    return in_next_scope(emit(files, next_checks()), files, tracked, git_repos)
