"""File classification: ordered predicates over path, name, size and a sample of the text.

Everything is a chain of column expressions (the order is the meaning), so a million
paths are one map-only stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and endings of the classification, as plain lists.
EXCLUDED_DIRECTORIES = {
    ".git": "version-control-metadata", ".hg": "version-control-metadata", ".svn": "version-control-metadata",
    "node_modules": "vendored-dependencies", "bower_components": "vendored-dependencies", "vendor": "vendored-dependencies",
    ".venv": "vendored-dependencies", "venv": "vendored-dependencies", "site-packages": "vendored-dependencies",
    "__pycache__": "generated-cache", ".tox": "tool-cache", ".nox": "tool-cache", ".pytest_cache": "tool-cache", ".mypy_cache": "tool-cache",
    ".ruff_cache": "tool-cache", ".ipynb_checkpoints": "generated-cache", "obj": "build-output", "dist": "build-output", "out": "build-output",
    "target": "build-output", "artifacts": "build-output", ".next": "framework-output", ".nuxt": "framework-output", ".svelte-kit": "framework-output",
    ".packages": "tool-cache", ".terraform": "tool-cache", ".pnpm-store": "tool-cache", ".vs": "tool-state",
}
EXCLUDED_PATHS = {".yarn/cache": "tool-cache", ".nuget/packages": "tool-cache"}
VENDORED_SEGMENTS = ("vendor", "third_party", "third-party", "external", "site-packages", ".venv", "venv")
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs", "e2e")
DOC_SEGMENTS = ("docs", "documentation")
DOC_EXTENSIONS = (".md", ".mdx", ".rst", ".adoc", ".asciidoc")
DOC_PREFIXES = ("readme", "changelog", "contributing", "license", "security")
CI_PREFIXES = (".github/workflows/", ".circleci/")
CI_NAMES = (".gitlab-ci.yml", ".gitlab-ci.yaml", "azure-pipelines.yml", "azure-pipelines.yaml", "jenkinsfile")
INFRA_SEGMENTS = ("terraform", "k8s", "kubernetes", "helm")
INFRA_EXTENSIONS = (".tf", ".tfvars", ".bicep")
COVERAGE_NAMES = (".coveragerc", "lcov.info", "cobertura.xml", "jacoco.xml", "codecov.yml", "codecov.yaml")
COVERAGE_EXTENSIONS = (".coverage", ".coveragexml", ".lcov", ".runsettings")
LOCK_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "packages.lock.json", "paket.lock", "composer.lock", "gemfile.lock", "poetry.lock", "pdm.lock", "uv.lock", "pipfile.lock", "cargo.lock", "go.sum", "gradle.lockfile", ".terraform.lock.hcl")
MANIFEST_NAMES = ("package.json", "pyproject.toml", "setup.cfg", "setup.py", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "cargo.toml")
PROJECT_EXTENSIONS = (".csproj", ".fsproj", ".vbproj", ".vcxproj", ".esproj")
PROJECT_NAMES = ("project.json",)
SOLUTION_EXTENSIONS = (".sln", ".slnx")
BUILD_NAMES = (
    "directory.build.props", "directory.build.targets", "directory.packages.props", "global.json", "nuget.config", "makefile", "cmakelists.txt", "taskfile.yml", "taskfile.yaml",
    "tsconfig.json", "jsconfig.json", ".npmrc", ".yarnrc", "pyproject.toml", "setup.cfg", "setup.py", "pipfile", "go.work", "settings.gradle", "settings.gradle.kts", "gradle.properties",
    "gradlew", "gradlew.bat", "mvnw", "mvnw.cmd", "tox.ini", "pytest.ini", ".coveragerc", "phpunit.xml", "phpunit.xml.dist", "phpstan.neon", "phpstan.neon.dist", "psalm.xml", "psalm.xml.dist",
    "build.rs", "rust-toolchain", "rust-toolchain.toml", "rustfmt.toml", ".rustfmt.toml", "clippy.toml", ".clippy.toml", "gnumakefile", "meson.build", "meson.options", "meson_options.txt",
    "cmakepresets.json", "cmakeuserpresets.json", "compile_commands.json", "vcpkg.json", "conanfile.txt", ".yarnrc.yml", ".editorconfig", ".gitattributes", ".gitignore",
    "angular.json", "nx.json", "turbo.json", "lerna.json", "pnpm-workspace.yaml", "pnpm-workspace.yml",
)
BUILD_PREFIXES = tuple(f"{tool}.config." for tool in ("webpack", "vite", "rollup", "next", "nuxt", "svelte", "jest", "vitest", "playwright", "cypress", "eslint", "prettier"))
BUILD_EXTENSIONS = (".props", ".targets", ".cmake", ".mk")
BINARY_EXTENSIONS = (
    ".7z", ".a", ".avi", ".bin", ".bmp", ".class", ".dat", ".db", ".dll", ".dylib", ".eot", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg", ".jpg", ".lockb", ".mov",
    ".mp3", ".mp4", ".o", ".otf", ".pdf", ".pdb", ".png", ".pyc", ".so", ".sqlite", ".tar", ".tiff", ".ttf", ".wav", ".webm", ".webp", ".woff", ".woff2", ".zip",
)
CONFIG_EXTENSIONS = (".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".config", ".xml", ".env")
LANGUAGES = {
    ".cs": "csharp", ".cshtml": "razor", ".razor": "razor", ".fs": "fsharp", ".fsx": "fsharp", ".vb": "visual-basic",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".html": "html", ".htm": "html", ".vue": "vue", ".svelte": "svelte", ".sql": "sql",
    ".tf": "terraform", ".tfvars": "terraform", ".tfbackend": "terraform", ".hcl": "hcl", ".graphql": "graphql", ".gql": "graphql",
    ".sh": "shell", ".bash": "shell", ".ksh": "shell", ".bats": "shell", ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell",
    ".py": "python", ".pyi": "python", ".ipynb": "jupyter", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".cppm": "cpp", ".ixx": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".inl": "cpp", ".ipp": "cpp", ".tpp": "cpp",
}
SHELL_PROFILES = (".profile", ".bash_profile", ".bash_login", ".bashrc")
SHELLS, POWERSHELLS = ("sh", "ash", "bash", "dash", "ksh"), ("pwsh", "powershell")
#: Ecosystem -> languages, names, endings that belong to it; a file may belong to several.
ECOSYSTEMS = {
    "dotnet": (("csharp", "razor", "fsharp", "visual-basic"), ("directory.build.props", "directory.build.targets", "directory.packages.props", "global.json", *PROJECT_NAMES), PROJECT_EXTENSIONS + SOLUTION_EXTENSIONS),
    "javascript": (("javascript", "vue", "svelte", "css", "scss", "sass", "less", "html"), ("package.json",), ()),
    "typescript": (("typescript",), ("tsconfig.json", "jsconfig.json"), ()),
    "sql": (("sql",), (), ()),
    "python": (("python", "jupyter"), ("pyproject.toml", "setup.cfg", "setup.py", "pipfile", "pipfile.lock", "poetry.lock", "pdm.lock", "uv.lock", "tox.ini", "pytest.ini", ".coveragerc"), ()),
    "go": (("go",), ("go.mod", "go.work", "go.sum"), ()),
    "java": (("java",), ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "gradle.lockfile", "gradlew", "gradlew.bat", "mvnw", "mvnw.cmd"), ()),
    "kotlin": (("kotlin",), (), ()),
    "shell": (("shell",), (), ()),
    "powershell": (("powershell",), (), ()),
    "terraform": (("terraform", "terraform-json", "hcl"), (".terraform.lock.hcl", "terraform.tfplan", "tfplan"), (".tfplan", ".tfstate")),
    "php": (("php",), ("composer.json", "composer.lock", "phpunit.xml", "phpunit.xml.dist", "phpstan.neon", "phpstan.neon.dist", "psalm.xml", "psalm.xml.dist"), ()),
    "rust": (("rust",), ("cargo.toml", "cargo.lock", "rust-toolchain", "rust-toolchain.toml", "rustfmt.toml", ".rustfmt.toml", "clippy.toml", ".clippy.toml"), ()),
    "cpp": (("c", "cpp"), ("cmakelists.txt", "meson.build", "cmakepresets.json", "cmakeuserpresets.json", "compile_commands.json", "vcpkg.json", "conanfile.txt"), (".vcxproj",)),
}
GENERATED_SEGMENTS = ("generated", "gen")
GENERATED_NAMES = r"\.g\.cs$|\.generated\.|\.designer\.cs$|\.assemblyattributes\.cs$"
GENERATED_MARKERS = ("<auto-generated", "@generated", "do not edit", "generated by")
SCRIPT_MARKERS = ("generated completion", "this file was generated by", "do not edit this generated")
PHP_CACHES = ("bootstrap/cache/", "var/cache/", "storage/framework/views/", "storage/framework/cache/")
LAUNCHERS = ("gradlew", "mvnw", "dotnet-install.sh", "install-powershell.ps1")
COMPLETIONS = ("completion", "completions", "bash-completion", "bash_completion.d", "shell-completion")
DATA_SEGMENTS = ("seed", "seeds", "fixture", "fixtures", "test-data", "testdata")
DUMP_SEGMENTS = ("dump", "dumps", "backup", "backups", "snapshot", "snapshots", "export", "exports")
DUMP_BANNERS = ("postgresql database dump", "mysql dump", "dumped from database version")
# Use of a script -> directories, file stems.
SCRIPT_USES = {
    "ci-configuration": ((".ci", "ci", "pipeline", "pipelines"), ("ci", "pipeline")),
    "infrastructure": (("deploy", "deployment", "devops", "ops", "provision"), ("deploy", "provision", "rollback", "teardown")),
    "delivery": (("release", "releases", "packaging"), ("install", "package", "pack", "publish", "release", "uninstall")),
    "build-configuration": (("build", "eng", "tooling"), ("build", "bootstrap", "clean", "configure", "format", "generate", "lint", "restore", "setup")),
}


def parts(path: Column) -> dict[str, Column]:
    """Lower-case path, name and extension (with its dot; none gives the empty text)."""
    low = F.lower(F.translate(path, "\\", "/"))
    name = F.element_at(F.split(low, "/"), -1)
    return {"low": low, "name": name, "ext": F.regexp_extract(name, r"(\.[^.]*)$", 1)}


def has_segment(low: Column, names) -> Column:
    """Is any directory or file name of the path one of ``names``?"""
    return low.rlike("(^|/)(" + "|".join(map(re.escape, names)) + ")(/|$)")


def _starts(x: Column, names) -> Column:
    return x.rlike("^(" + "|".join(map(re.escape, names)) + ")")


def stem(name: Column) -> Column:
    """Name of a script without its ending."""
    return F.regexp_replace(name, r"\.(sh|bash|ksh|bats|ps1|psm1|psd1)$", "")


def language(name: Column, ext: Column, sample: Column | None = None) -> Column:
    """Language by name, ending or, for files without an ending, the interpreter in the first line."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)
    out = (
        F.when((name == ".terraform.lock.hcl") | is_state(name), F.lit(None).cast("string"))
        .when(name.rlike(r"\.(tf|tfvars)\.json$"), "terraform-json")
        .when(name.isin(".terraformrc", "terraform.rc"), "hcl")
        .when(known.isNotNull(), known)
        .when(name.isin(*SHELL_PROFILES), "shell")
    )
    if sample is None:
        return out
    first = F.lower(F.regexp_extract(F.coalesce(sample, F.lit("")), r"^\uFEFF?\s*#!([^\r\n]*)", 1))
    runs = lambda names: first.rlike(r"(^|[\s/])(" + "|".join(names) + r")(\s|$)")
    script = F.when(runs(POWERSHELLS), "powershell").when(runs(SHELLS), "shell")
    return out.when(ext.isin("", ".command"), script)


def is_state(name: Column) -> Column:
    """State and plan files of infrastructure tools."""
    return name.rlike(r"\.tfstate(\.backup)?$|\.tfplan$|^tfplan$")


def is_docker(name: Column) -> Column:
    return name.rlike(r"^dockerfile(\.|$)|\.dockerfile$|^(docker-)?compose\..*\.ya?ml$|^(docker-)?compose\.ya?ml$|^\.dockerignore$")


def ecosystems(low: Column, name: Column, ext: Column, lang: Column) -> Column:
    """All ecosystems a file belongs to, in the canonical order."""
    extra = {
        "python": name.rlike(r"^requirements.*\.(txt|in)$"),
        "rust": name.isin("config", "config.toml") & has_segment(low, (".cargo",)),
        "terraform": is_state(name),
    }
    rows = [
        F.when(F.coalesce(lang.isin(*langs), F.lit(False)) | name.isin(*names) | ext.isin(*ends) | extra.get(eco, F.lit(False)), eco)
        for eco, (langs, names, ends) in ECOSYSTEMS.items()
    ]
    return F.array_compact(F.array(*rows, F.when(is_docker(name), "docker")))


def exclusion_reason(path: Column) -> Column:
    """Why the topmost excluded directory of a path is left out; null for a path that is scanned."""
    low = parts(path)["low"]
    names = F.create_map(*[F.lit(x) for kv in EXCLUDED_DIRECTORIES.items() for x in kv])
    at = F.split(low, "/")
    above = F.transform(F.slice(at, 1, F.size(at) - 1), lambda d: F.element_at(names, d))
    out = F.get(F.array_compact(above), 0)
    for p, reason in EXCLUDED_PATHS.items():
        out = F.coalesce(F.when(low.startswith(p + "/"), reason), out)
    return out


def is_excluded(path: Column) -> Column:
    return exclusion_reason(path).isNotNull()


def is_test(path: Column, low: Column, name: Column, lang: Column) -> Column:
    """Test sources by the rules of their language; container files never are."""
    lang = F.coalesce(lang, F.lit(""))
    own = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)  # Java and Kotlin tell by case
    script = lang.isin("shell", "powershell") & (
        name.endswith(".bats") | has_segment(low, ("test", "tests", "spec", "specs", "smoke")) | stem(name).rlike(r"^test[-_]|[-_]test$|\.tests?$|\.spec$")
    )
    return ~is_docker(name) & (
        script
        | (lang.isin("terraform", "hcl") & name.rlike(r"\.(tftest|tfmock)\.hcl$"))
        | has_segment(low, TEST_SEGMENTS)
        | ((lang == "sql") & has_segment(low, ("fixture", "fixtures", "test-data", "testdata")))
        | ((lang == "python") & name.rlike(r"^test_|_test\.py$|^conftest\.py$"))
        | ((lang == "go") & (name.endswith("_test.go") | has_segment(low, ("testdata",))))
        | ((lang == "java") & own.rlike(r"(Tests?|TestCase|IT)\.java$"))
        | ((lang == "kotlin") & own.rlike(r"(Tests?|TestCase|IT)\.kts?$"))
        | ((lang == "php") & name.rlike(r"tests?\.php$|^pest\.php$|^testcase\.php$"))
        | ((lang == "rust") & has_segment(low, ("tests", "benches")))
        | (lang.isin("c", "cpp") & (has_segment(low, ("end-to-end",)) | name.rlike(r"_tests?\.")))
        | name.rlike(r"\.test\.|\.spec\.|tests?\.cs$|tests?\.csproj$")
    )


def is_minified(name: Column, ext: Column, size: Column, lines: Column) -> Column:
    wide = ext.isin(".js", ".css") & (size >= 1024) & (lines > 0) & (F.floor(size / lines) > 300)
    return name.contains(".min.") | name.endswith(".bundle.js") | F.coalesce(wide, F.lit(False))


def _holds(low_text: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | low_text.contains(m)
    return F.coalesce(out, F.lit(False))


def has_generated_marker(sample: Column) -> Column:
    return _holds(F.lower(sample), GENERATED_MARKERS)


def is_sql_dump(low: Column, name: Column, lang: Column, sample: Column) -> Column:
    """SQL that is data and not maintained: by place, by banner, or by forty inserts outside seed data."""
    text = F.lower(F.coalesce(sample, F.lit("")))
    kept = has_segment(low, DATA_SEGMENTS)
    place = has_segment(low, DUMP_SEGMENTS) | name.rlike(r"\.(dump|bak|snapshot)\.sql$")
    copied = text.contains(" from stdin;") & text.contains("copy ")
    return (F.coalesce(lang, F.lit("")) == "sql") & ((~kept & (place | (F.regexp_count(text, F.lit("insert into ")) >= 40))) | _holds(text, DUMP_BANNERS) | copied)


def is_generated(low: Column, name: Column, lang: Column, sample: Column) -> Column:
    """By convention of its path, or by marks in its text; a notebook's text does not tell."""
    lang, text = F.coalesce(lang, F.lit("")), F.lower(F.coalesce(sample, F.lit("")))
    completion = has_segment(low, COMPLETIONS) | name.rlike(r"[-._]completion\.sh$|\.bash-completion$")
    script = lang.isin("shell", "powershell") & (name.isin(*LAUNCHERS) | completion | _holds(text, SCRIPT_MARKERS))
    return (
        has_segment(low, GENERATED_SEGMENTS)
        | name.rlike(GENERATED_NAMES)
        | is_sql_dump(low, name, lang, sample)
        | is_state(name)
        | script
        | ((lang == "php") & low.rlike("(^|/)(" + "|".join(PHP_CACHES) + ")"))
        | ((lang != "jupyter") & has_generated_marker(text))
    )


def script_use(low: Column, name: Column, lang: Column, use: str) -> Column:
    """Does a script serve the use: by a directory above it or by its name?"""
    folders, stems = SCRIPT_USES[use]
    out = has_segment(low, folders) | stem(name).isin(*stems)
    if use == "build-configuration":
        out = out | name.endswith(".psd1") | name.isin(*SHELL_PROFILES)
    return F.coalesce(lang, F.lit("")).isin("shell", "powershell") & out


def script_role(path: Column, sample: Column | None = None) -> Column:
    """What a script is for: test, ci, infrastructure, delivery, build, or other; null for other files."""
    p = parts(path)
    lang = language(p["name"], p["ext"], sample)
    use = lambda u: script_use(p["low"], p["name"], lang, u)
    return F.when(
        lang.isin("shell", "powershell"),
        F.when(is_test(path, p["low"], p["name"], lang), "test")
        .when(use("ci-configuration"), "ci")
        .when(use("infrastructure"), "infrastructure")
        .when(use("delivery"), "delivery")
        .when(use("build-configuration"), "build")
        .otherwise("other"),
    )


def role(path: Column, size: Column | None = None, lines: Column | None = None, sample: Column | None = None, binary: Column | None = None) -> Column:
    """Role of a file: the first rule that fits."""
    p = parts(path)
    low, name, ext = p["low"], p["name"], p["ext"]
    lang = language(name, ext, sample)
    known = F.coalesce(lang, F.lit(""))
    size, lines = F.lit(0) if size is None else size, F.lit(0) if lines is None else lines
    sample = F.lit("") if sample is None else sample
    binary = ext.isin(*BINARY_EXTENSIONS) if binary is None else binary | ext.isin(*BINARY_EXTENSIONS)
    coverage = has_segment(low, ("coverage",)) | name.startswith("coverage.") | name.contains("coverlet") | name.isin(*COVERAGE_NAMES) | ext.isin(*COVERAGE_EXTENSIONS)
    docs = has_segment(low, DOC_SEGMENTS) | ext.isin(*DOC_EXTENSIONS) | _starts(name, DOC_PREFIXES)
    build = name.isin(*BUILD_NAMES) | _starts(name, BUILD_PREFIXES) | ext.isin(*BUILD_EXTENSIONS) | name.rlike(r"\.gradle\.kts$|^requirements.*\.(txt|in)$")
    use = lambda u: script_use(low, name, lang, u)
    rules = (
        ("vendored", has_segment(low, VENDORED_SEGMENTS)),
        ("minified", is_minified(name, ext, size, lines)),
        ("generated", is_generated(low, name, lang, sample)),
        ("coverage", coverage),
        ("dependency-lock", name.isin(*LOCK_NAMES)),
        ("test", is_test(path, low, name, lang)),
        ("documentation", docs),
        ("ci-configuration", _starts(low, CI_PREFIXES) | name.isin(*CI_NAMES) | use("ci-configuration")),
        ("container-configuration", is_docker(name)),
        ("infrastructure", known.isin("terraform", "terraform-json", "hcl") | ext.isin(*INFRA_EXTENSIONS) | has_segment(low, INFRA_SEGMENTS) | (name == "chart.yaml") | use("infrastructure")),
        ("delivery", use("delivery")),
        ("build-configuration", use("build-configuration")),
        ("binary", binary),
        ("package-manifest", name.isin(*MANIFEST_NAMES)),
        ("project", ext.isin(*PROJECT_EXTENSIONS) | name.isin(*PROJECT_NAMES)),
        ("solution", ext.isin(*SOLUTION_EXTENSIONS)),
        ("build-configuration", build | (name.isin("config", "config.toml") & has_segment(low, (".cargo",)))),
        ("source", known != ""),
        ("configuration", ext.isin(*CONFIG_EXTENSIONS) | name.startswith(".env.")),
    )
    out = F.when(rules[0][1], rules[0][0])
    for label, test in rules[1:]:
        out = out.when(test, label)
    return out.otherwise("other")


def classified(files: DataFrame, path: str = "path", size: str = "bytes", lines: str = "lines", sample: str = "text", binary: str | None = None) -> DataFrame:
    """Files with language, ecosystems, role and flags; ``binary`` names a column that tells by content."""
    p = parts(F.col(path))
    lang = language(p["name"], p["ext"], F.col(sample))
    return files.withColumns(
        {
            "language": lang,
            "ecosystems": ecosystems(p["low"], p["name"], p["ext"], lang),
            "role": role(F.col(path), F.col(size), F.col(lines), F.col(sample), None if binary is None else F.col(binary)),
            "is_test": is_test(F.col(path), p["low"], p["name"], lang),
            "is_generated": is_generated(p["low"], p["name"], lang, F.col(sample)),
            "is_minified": is_minified(p["name"], p["ext"], F.col(size), F.col(lines)),
            "is_vendored": has_segment(p["low"], VENDORED_SEGMENTS),
            "is_manifest": p["name"].isin(*MANIFEST_NAMES, *PROJECT_NAMES) | p["ext"].isin(*PROJECT_EXTENSIONS),
            "is_excluded": is_excluded(F.col(path)),
        }
    )


def glob_regex(pattern: str) -> str:
    """Regular expression of an ignore pattern's glob: ``*``, ``**``, ``?`` and classes."""
    if len(pattern) > 4096:
        raise ValueError("pattern too long")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" if body[0] in "!^" else "") + body.lstrip("!^").replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def ignore_rule(line: str, base: str = "") -> tuple[str, bool] | None:
    """(regex over a path, negated) of one ignore line of the rule file in directory ``base``; None for blanks and comments.

    A backslash before a leading ``!`` or ``#`` takes its meaning away.
    """
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated or line.startswith("\\!") else line
    body = body[1:] if body.startswith("\\#") else body
    directory, body = body.endswith("/"), body.removesuffix("/")
    anchored, body = "/" in body, body.removeprefix("/")
    if not body:
        return None
    at = "^" + (re.escape(base.strip("/")) + "/" if base.strip("/") else "")
    return at + ("" if anchored else "(?:.*/)?") + glob_regex(body) + ("/" if directory else "(?:/|$)"), negated


def ignored(files: DataFrame, lines: list[str], path: str = "path", below: dict[str, list[str]] | None = None) -> DataFrame:
    """``ignored`` by the last rule that fits; rules are a short list inside the projection.

    ``below``: directory -> lines of its own rule file, which hold for what lies in it and come after those above.
    """
    files_of_rules = [("", lines), *sorted((below or {}).items(), key=lambda x: (x[0].count("/"), x[0]))]
    verdict = F.lit(False)
    for regex, negated in filter(None, (ignore_rule(x, base) for base, some in files_of_rules for x in some)):
        verdict = F.when(F.col(path).rlike(regex), F.lit(not negated)).otherwise(verdict)
    return files.withColumn("ignored", verdict)
