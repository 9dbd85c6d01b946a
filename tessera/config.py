"""Settings and constant tables.  All operators take what they need as plain parameters; these are the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    """Thresholds of chunking, search and assembly.  `from_env` overrides them by upper-case names."""

    ast_split_enabled: bool = True
    chunk_max_tokens: int = 600
    chunk_min_tokens: int = 30
    code_languages: tuple[str, ...] = ("go", "java", "javascript", "python", "rust", "sql", "typescript")
    cross_file_assembly_enabled: bool = True
    cross_file_budget_threshold: float = 0.7
    cross_file_max_chunks: int = 3
    docs_languages: tuple[str, ...] = tuple(["markdown"])
    embedding_batch_max_tokens: int = 100_000
    embedding_dimensions: int = 1024
    file_only_max_lines: int = 200
    hierarchical_assembly_enabled: bool = True
    index_concurrency: int = 10
    log_level: str = "INFO"
    max_file_size_kb: int = 500
    max_symbols_per_file: int = 5
    per_file_budget_ratio: float = 0.45
    rerank_relative_factor: float = 0.75
    rerank_score_floor: float = 0.4
    rerank_top_k_output: int = 8
    result_max_tokens: int = 8000
    retrieval_k: int = 50
    retry_base_delay_ms: int = 250
    retry_jitter_ms: int = 250
    retry_max_attempts: int = 5
    retry_max_delay_ms: int = 5000
    search_log_path: str | None = None
    similarity_threshold: float = 0.3
    small_file_lines: int = 200
    token_pattern: str = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
    token_vocabulary: str | None = None

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        env = dict(os.environ) if env is None else env
        given: dict = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(f.default, tuple):
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            elif isinstance(f.default, (int, float)):
                given[f.name] = type(f.default)(raw)
            else:
                given[f.name] = raw
        return cls(**given)


@dataclass(frozen=True)
class Language:
    name: str
    suffixes: tuple[str, ...]
    strategy: str  # code, statement, section or file_only
    keywords: tuple[str, ...] = field(default=())


LANGUAGES: dict[str, Language] = {
    x.name: x
    for x in (
        Language("css", (".css", ".less", ".scss"), "file_only"),
        Language("go", (".go",), "code"),
        Language("html", (".htm", ".html"), "file_only"),
        Language("java", (".java",), "code"),
        Language("javascript", (".cjs", ".js", ".jsx", ".mjs"), "code"),
        Language("json", (".json",), "file_only"),
        Language("markdown", (".md", ".mdx"), "section"),
        Language("python", (".py", ".pyi"), "code"),
        Language("rust", (".rs",), "code"),
        Language("sql", (".sql",), "statement"),
        Language("toml", (".toml",), "file_only"),
        Language("typescript", (".ts", ".tsx"), "code"),
        Language("yaml", (".yaml", ".yml"), "file_only"),
    )
}
SUFFIX_LANGUAGE: dict[str, str] = {s: x.name for x in LANGUAGES.values() for s in x.suffixes}

#: Exact names of directories and files that are never read.
IGNORED_NAMES: frozenset[str] = frozenset(
    sorted(
        """__backlog__ __pycache__ _archive archive backup-version bkp_ build bun.lock Cargo.lock chaves coverage
        credentials dist drizzle .DS_Store .alchemy .angular .astro .cache .cxx .docker .env .expo .git .hg .mypy_cache
        .next .nitro .nuxt .nyc_output .open-next .output .parcel-cache .pytest_cache .report .reports .ruff_cache
        .specify .sst .svelte-kit .svn .terraform .trigger .turbo .venv .vercel .vinxi .wrangler env node_modules
        package-lock.json playwright-report pnpm-lock.yaml Pods poetry.lock reports reverse-database secrets
        seedRecords storybook-static target test-results venv yarn.lock""".split()
    )
)
#: A file whose name contains one of these is never read.
IGNORED_PARTS: tuple[str, ...] = tuple(sorted(("-env.d.ts", ".map", "worker-configuration.d.ts", ".chunk.js", ".bundle.js", ".min.css", ".min.js", ".report.", "-report-")))

#: Ranking instruction of each intent, in our own words.
INTENTS: dict[str, str] = {
    "architecture": "Rank first what shapes the system: boundaries, contracts between modules, adapters and orchestration.",
    "debug": "Rank first what handles failure: error paths, retries, timeouts, guards and the signals that explain a cause.",
    "definition": "Rank first where things are declared: types, interfaces, schemas, enumerations and configuration.",
    "implementation": "Rank first the code that does what is asked and would be edited to change it.",
    "performance": "Rank first what costs time or memory: hot loops, queries, batching, caching and queues.",
    "security": "Rank first what protects: authentication, permission checks, secrets and input validation.",
    "usage": "Rank first call sites that show how the thing is invoked and wired together.",
}
DEFAULT_INTENT = "implementation"
INTENT_ALIASES: dict[str, str] = dict(
    sorted(
        {
            "arch": "architecture", "design": "architecture", "bugfix": "debug", "schema": "definition", "troubleshoot": "debug", "types": "definition",
            "impl": DEFAULT_INTENT, "auth": "security", "perf": "performance", "authz": "security", "speed": "performance", "calls": "usage", "examples": "usage",
        }.items()
    )
)
RANKING_RULES = (
    "A direct answer beats a passing mention.",
    "A chunk of one symbol beats a whole file where both fit.",
    "Boilerplate and unrelated helpers come last.",
)
RULE_TESTS = "Tests, fixtures and mocks come last unless nothing else answers."
RULE_DECLARATIONS = "Declarations and contracts beat long bodies."
RULE_PATHS = "Callers and handlers on the path of execution beat static definitions."

#: Type names that say nothing about a project.
BUILTIN_TYPES: frozenset[str] = frozenset(
    """ABC Annotated Any Array AsyncGenerator AsyncIterable AsyncIterator Awaitable Awaited BaseModel BigInt Boolean
    Callable Capitalize ClassVar Component ConstructorParameters Coroutine Date Dict Enum Error Event Exclude Extract FC
    False Field Final Function Generator Generic HTMLElement InstanceType Iterable Iterator JSX List Literal Lowercase
    Map Mapping NamedTuple NonNullable None Number Object Omit OmitThisParameter Optional Override ParamSpec Parameters
    Partial Pick Promise Protocol React Readonly Record RegExp Required ReturnType Self Sequence Set String Symbol
    ThisParameterType True Tuple Type TypeAlias TypeVar TypedDict Uncapitalize Union Uppercase""".split()
)
OUTCOMES = ("ok", "no_candidates", "below_similarity_threshold", "empty_after_budget")
