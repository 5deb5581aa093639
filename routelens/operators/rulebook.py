"""Rules of real frameworks: manifests, route files, authentication, ports and source globs.

Only values live here; the operators that read them are in ``profile.py`` and ``detect.py``.
"""

from __future__ import annotations

# Ecosystems in order of priority, with their manifests in order of search
# (path regex, kind of reader) and their rules in order: needle, framework, language.
JAVASCRIPT = [
    ("express", "express", "javascript"), ("@nestjs/core", "nestjs", "typescript"), ("fastify", "fastify", "javascript"),
    ("koa", "koa", "javascript"), ("@hapi/hapi", "hapi", "javascript"), ("hapi", "hapi", "javascript"),
    ("hono", "hono", "javascript"), ("@hono/node-server", "hono", "javascript"), ("restify", "restify", "javascript"),
    ("@adonisjs/core", "adonis", "javascript"),
]
PYTHON = [
    ("fastapi", "fastapi", "python"), ("flask-restplus", "flask", "python"), ("flask-restx", "flask", "python"),
    ("flask", "flask", "python"), ("django-rest-framework", "django", "python"), ("djangorestframework", "django", "python"),
    ("django", "django", "python"), ("starlette", "starlette", "python"), ("tornado", "tornado", "python"),
    ("falcon", "falcon", "python"), ("sanic", "sanic", "python"), ("litestar", "litestar", "python"),
    ("bottle", "bottle", "python"),
]
JAVA = [
    ("spring-boot-starter-web", "spring", "java"), ("spring-boot-starter-webflux", "spring", "java"),
    ("spring-webmvc", "spring", "java"), ("jersey-server", "jersey", "java"), ("resteasy", "resteasy", "java"),
    ("quarkus-resteasy", "quarkus", "java"), ("micronaut-http-server", "micronaut", "java"),
]
GO = [
    ("github.com/gin-gonic/gin", "gin", "go"), ("github.com/labstack/echo", "echo", "go"),
    ("github.com/gofiber/fiber", "fiber", "go"), ("github.com/go-chi/chi", "chi", "go"),
    ("github.com/gorilla/mux", "gorilla", "go"), ("net/http", "net/http", "go"),
    ("", None, "go"),  # a module of no known framework still names the language
]
RUBY = [("rails", "rails", "ruby"), ("sinatra", "sinatra", "ruby"), ("grape", "grape", "ruby"), ("roda", "roda", "ruby")]
RUST = [("actix-web", "actix-web", "rust"), ("axum", "axum", "rust"), ("rocket", "rocket", "rust"), ("warp", "warp", "rust")]
PHP = [
    ("laravel/framework", "laravel", "php"), ("slim/slim", "slim", "php"), ("symfony/framework-bundle", "symfony", "php"),
    ("laravel/lumen-framework", "lumen", "php"),
]
CSHARP = [("Microsoft.AspNetCore", "aspnetcore", "csharp"), ("Microsoft.NET.Sdk.Web", "aspnetcore", "csharp")]

ECOSYSTEMS = [  # name, manifests (path regex, reader), rules
    ("javascript", [(r"^package\.json$", "npm")], JAVASCRIPT),
    ("python", [(r"^pyproject\.toml$", "word"), (r"^requirements\.txt$", "word"), (r"^setup\.py$", "word"),
                (r"^setup\.cfg$", "word"), (r"^Pipfile$", "word")], PYTHON),
    ("java", [(r"^pom\.xml$", "contains"), (r"^build\.gradle$", "contains"), (r"^build\.gradle\.kts$", "contains")], JAVA),
    ("go", [(r"^go\.mod$", "contains")], GO),
    ("ruby", [(r"^Gemfile$", "gem")], RUBY),
    ("rust", [(r"^Cargo\.toml$", "contains")], RUST),
    ("php", [(r"^composer\.json$", "composer")], PHP),
    ("csharp", [(r"\.csproj$", "contains")], CSHARP),
]
# Directories a C# project file is not looked for in.
CSHARP_SKIPPED = r"(^|/)(bin|obj)/"

# Route files by framework, (framework, glob, regex within one line).
ROUTE_RULES = [
    ("express", "**/*.{js,ts}", r"""\w+\.(get|post|put|patch|delete|all|route)\s*\(\s*['"/]"""),
    ("fastify", "**/*.{js,ts}", r"""\w+\.(get|post|put|patch|delete|route)\s*\(\s*['"/]"""),
    ("koa", "**/*.{js,ts}", r"""\w+\.(get|post|put|patch|delete|all)\s*\(\s*['"/]"""),
    ("hapi", "**/*.{js,ts}", r"server\.route\s*\("),
    ("hono", "**/*.{js,ts}", r"(app|router)\.(get|post|put|patch|delete|all)\s*\("),
    ("nestjs", "**/*.ts", r"@(Get|Post|Put|Patch|Delete|All)\s*\("),
    ("nestjs", "**/*.ts", r"@Controller\s*\("),
    ("restify", "**/*.{js,ts}", r"server\.(get|post|put|patch|del)\s*\("),
    ("adonis", "**/*.{js,ts}", r"Route\.(get|post|put|patch|delete|resource)\s*\("),
    ("fastapi", "**/*.py", r"@(app|router)\.(get|post|put|patch|delete|api_route)\s*\("),
    ("fastapi", "**/*.py", r"\.include_router\s*\("),
    ("flask", "**/*.py", r"@(app|blueprint|bp|api)\.(route|get|post|put|patch|delete)\s*\("),
    ("flask", "**/*.py", r"\.add_url_rule\s*\("),
    ("django", "**/urls.py", r"(path|re_path|url)\s*\("),
    ("django", "**/*.py", r"@(api_view|action)\s*\("),
    ("django", "**/*.py", r"\.(register)\s*\("),
    ("starlette", "**/*.py", r"Route\s*\("),
    ("tornado", "**/*.py", r"(url|URLSpec)\s*\("),
    ("falcon", "**/*.py", r"(app|api)\.add_route\s*\("),
    ("sanic", "**/*.py", r"@(app|bp)\.(get|post|put|patch|delete|route)\s*\("),
    ("bottle", "**/*.py", r"@(app|route)\.(get|post|put|patch|delete|route)\s*\("),
    ("spring", "**/*.{java,kt}",
     r"@(GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping|RestController|Controller)\b"),
    ("spring", "**/*.{java,kt}", r"RouterFunction|RouterFunctions"),
    ("quarkus", "**/*.{java,kt}", r"@(GET|POST|PUT|PATCH|DELETE|Path)\b"),
    ("micronaut", "**/*.{java,kt}", r"@(Get|Post|Put|Patch|Delete|Controller)\b"),
    ("jersey", "**/*.java", r"@(GET|POST|PUT|PATCH|DELETE|Path)\b"),
    ("resteasy", "**/*.java", r"@(GET|POST|PUT|PATCH|DELETE|Path)\b"),
    ("gin", "**/*.go", r"\.(GET|POST|PUT|PATCH|DELETE|Handle|Any|Group)\s*\("),
    ("echo", "**/*.go", r"\.(GET|POST|PUT|PATCH|DELETE|Add|Group)\s*\("),
    ("fiber", "**/*.go", r"\.(Get|Post|Put|Patch|Delete|All|Group)\s*\("),
    ("chi", "**/*.go", r"\.(Get|Post|Put|Patch|Delete|Route|Mount|Group)\s*\("),
    ("gorilla", "**/*.go", r"\.(HandleFunc|Handle|Methods)\s*\("),
    ("net/http", "**/*.go", r"http\.(HandleFunc|Handle|ListenAndServe)"),
    ("rails", "config/routes.rb", r"(get|post|put|patch|delete|resources|resource|mount)\s"),
    ("rails", "app/controllers/**/*.rb", r"def\s+(index|show|create|update|destroy|new|edit)"),
    ("sinatra", "**/*.rb", r"""(get|post|put|patch|delete)\s+['"/]"""),
    ("grape", "**/*.rb", r"""(get|post|put|patch|delete|route)\s+['"/:]"""),
    ("actix-web", "**/*.rs", r"#\[(get|post|put|patch|delete)\s*\("),
    ("actix-web", "**/*.rs", r"\.(route|resource)\s*\("),
    ("axum", "**/*.rs", r"\.(get|post|put|patch|delete|route)\s*\("),
    ("rocket", "**/*.rs", r"#\[(get|post|put|patch|delete)\s*\("),
    ("warp", "**/*.rs", r"warp::(get|post|put|patch|delete|path)\s*\("),
    ("laravel", "routes/*.php", r"Route::(get|post|put|patch|delete|resource|apiResource|group|controller)\s*\("),
    ("laravel", "**/*.php", r"Route::(get|post|put|patch|delete|apiResource)\s*\("),
    ("slim", "**/*.php", r"\$(app|group)->(get|post|put|patch|delete)\s*\("),
    ("symfony", "**/*.php", r"#\[(Route|Get|Post|Put|Patch|Delete)\s*\("),
    ("symfony", "config/routes*.yaml", r"(path|resource):"),
    ("aspnetcore", "**/*.cs", r"\[(Http(Get|Post|Put|Patch|Delete)|Route|ApiController)(\([^\]\n]*\))?\]"),
    ("aspnetcore", "**/*.cs", r"\.(Map(Get|Post|Put|Patch|Delete|Group|Methods))\s*\("),
    ("dart_frog", "**/routes/**/*.dart", r"(Future<Response>|Response)\s+\w+\s*\("),
    ("shelf", "**/*.dart", r"Router\(\)"),
    ("vapor", "**/*.swift", r"(RouteCollection|func\s+boot\s*\(\s*routes\s*:)"),
    ("vapor", "**/*.swift", r"\.(get|post|put|patch|delete)\s*\("),
]

# Lines that tell how endpoints are protected, (order, regex, mode).
AUTH_RULES = [
    (0, r"(?i)before_action\s+:auth", "all"), (1, r"(?i)before_filter\s+:auth", "all"),
    (2, r"\.authorizeRequests\b|\.authorizeHttpRequests\b", "all"), (3, r"\[Authorize\]", "per-endpoint"),
    (4, r"@PreAuthorize\b", "per-endpoint"), (5, r"@UseGuards\b", "per-endpoint"),
    (6, r"(?i)\bmiddleware\b.*\b(auth|jwt|bearer|token)\b", "all"), (7, r"SecuritySchemeType\b", "per-endpoint"),
    (8, r"(?i)passport\.(authenticate|use)\b", "per-endpoint"), (9, r"(?i)skip_before_action\s+:auth", "skip"),
    (10, r"(?i)AllowAnonymous", "skip"), (11, r"(?i)permitAll", "skip"),
]

# Ports in configuration and source, the port in group 1.
PORT_RULES = [(0, r"(?m)^PORT\s*=\s*(\d+)"), (1, r"\.listen\s*\(\s*(\d{2,5})"), (2, r"port\s*=\s*(\d{2,5})"),
              (3, r"server\.port\s*=\s*(\d{2,5})"), (4, r"\bPORT\s*=\s*(\d{2,5})")]
# Configuration files in order of search, environment files first but for the JVM languages.
ENVIRONMENT_FILES = [".env", ".env.example", ".env.local"]
SPRING_FILES = ["application.properties", "application.yml", "application.yaml", "src/main/resources/application.properties",
                "src/main/resources/application.yml", "src/main/resources/application.yaml"]
# Words in the names of a program's entry files.
ENTRY_WORDS = ("main", "app", "server", "index", "program", "startup")
DEFAULT_PORTS = {"javascript": 3000, "typescript": 3000, "python": 8000, "java": 8080, "kotlin": 8080, "go": 8080,
                 "ruby": 3000, "rust": 8080, "php": 8000, "csharp": 5000}

# Extensions of a language's sources, and of sources of an unknown language.
SOURCE_EXTENSIONS = {
    "javascript": ["js", "ts", "mjs", "cjs"], "typescript": ["ts", "js", "mjs", "cjs"], "python": ["py"], "go": ["go"],
    "ruby": ["rb"], "rust": ["rs"], "php": ["php"], "java": ["java", "kt"], "kotlin": ["kt", "java"], "csharp": ["cs"],
    "swift": ["swift"], "dart": ["dart"], "haskell": ["hs"], "ocaml": ["ml", "mli"], "clojure": ["clj", "cljs", "cljc"],
}
ANY_EXTENSIONS = ["rb", "py", "js", "ts", "go", "java", "kt", "cs", "php", "rs", "swift", "dart"]
