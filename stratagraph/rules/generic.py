"""Rules for the parts of any configuration."""

from pyspark.sql import functions as F

from .registry import attr, falsy, registry, truthy

rule = registry.rule
# Fixed values.
REQUIRED_NAMES = ("access_key", "secret_key", "token", "password", "private_key")
SECRET_WORDS = ("password", "secret", "key", "token", "credential", "private", "certificate", "ssh_key", "pem", "jwt", "api_key")
GENERIC_MODULES = ("module", "main", "test", "example", "default")
FILTERED_DATA = ("aws_ami", "aws_instance", "azurerm_resource_group", "google_compute_image")
SNAKE = "^[a-z][a-z0-9_]*$"


def _not_snake():
    return [(~F.col("name").rlike(SNAKE), "Name is not in snake case")]


def _set(rule_id, severity, kind, path, message, priority):
    def checks():
        return [(falsy(path), message)]

    checks.__doc__ = f"{kind} sets {path}."
    rule(rule_id, severity, "best_practices", kind, priority=priority, suggestion=f"Set {path}")(checks)


_set("TF-CONFIG-001", "warning", "terraform", "required_version", "No required version", 20)
_set("TF-CONFIG-002", "warning", "terraform", "backend", "No backend", 15)
_set("TF-CONFIG-003", "warning", "terraform", "required_providers", "No required providers", 10)


@rule("TF-PROVIDER-001", "warning", "best_practices", "provider", priority=20, suggestion="Constrain the version")
def _():
    """Main provider blocks have a version."""
    return [(attr("alias").isNull() & falsy("version"), "Provider has no version")]


@rule("TF-PROVIDER-002", "info", "best_practices", "provider", priority=15, suggestion="Complete the provider")
def _():
    """Providers have what their cloud needs."""
    name = F.col("name")
    # A block stands in a list, so an empty one is there all the same.
    no_features = attr("features").isNull() | attr("features").isin("{}", "[]")
    return [((name == "aws") & falsy("region"), "No region"), ((name == "azurerm") & no_features, "No features block"), ((name == "google") & falsy("region") & falsy("zone"), "No region or zone")]


@rule("TF-VARIABLE-001", "info", "best_practices", "variable", priority=10, suggestion="Describe it")
def _():
    """Variables are described."""
    return [(F.coalesce(F.col("description"), F.lit("")) == "", "Variable has no description")]


@rule("TF-VARIABLE-002", "warning", "best_practices", "variable", priority=15, suggestion="Give a type")
def _():
    """Variables are typed."""
    return [(F.coalesce(F.col("variable_type"), F.lit("")) == "", "Variable has no type")]


@rule("TF-VARIABLE-003", "info", "best_practices", "variable", priority=5, suggestion="Give a default or nullable = false")
def _():
    """Optional variables have a default."""
    return [(F.col("default_value").isNull() & F.coalesce(F.col("nullable"), F.lit(True)) & ~F.col("name").isin(*REQUIRED_NAMES), "Variable has no default")]


@rule("TF-VARIABLE-004", "warning", "naming", "variable", priority=10, suggestion="Use snake case")
def _():
    """Variables are in snake case."""
    return _not_snake()


@rule("TF-OUTPUT-001", "info", "best_practices", "output", priority=10, suggestion="Describe it")
def _():
    """Outputs are described."""
    return [(F.coalesce(F.col("description"), F.lit("")) == "", "Output has no description")]


@rule("TF-OUTPUT-002", "warning", "security", "output", priority=20, suggestion="Mark it sensitive")
def _():
    """Outputs that look secret are marked."""
    return [(F.lower("name").rlike("|".join(SECRET_WORDS)) & ~F.coalesce(F.col("sensitive"), F.lit(False)), "Output looks secret and is not marked so")]


@rule("TF-LOCAL-001", "info", "best_practices", "local", priority=5, suggestion="Split the expression")
def _():
    """Locals are simple."""
    text = F.coalesce(attr("value"), F.lit(""))
    return [((F.length(text) - F.length(F.replace(text, F.lit("${"), F.lit("")))) / 2 > 5, "Local has many interpolations")]


@rule("TF-LOCAL-002", "warning", "naming", "local", priority=10, suggestion="Use snake case")
def _():
    """Locals are in snake case."""
    return _not_snake()


@rule("TF-MODULE-001", "warning", "best_practices", "module", priority=25, suggestion="Pin a version or ref")
def _():
    """Remote modules are pinned."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return [(source.rlike("^(git::|github\\.com|bitbucket\\.org|git@)") & (F.coalesce(F.col("module_version"), F.lit("")) == "") & ~source.contains("?ref="), "Remote module is not pinned")]


@rule("TF-MODULE-002", "warning", "naming", "module", priority=10, suggestion="Say what it makes")
def _():
    """Modules have telling names in snake case."""
    generic = F.col("name").isin(*GENERIC_MODULES)
    return [(generic, "Module name is generic"), (~generic & ~F.col("name").rlike(SNAKE), "Name is not in snake case")]


@rule("TF-DATA-001", "warning", "best_practices", "data", priority=15, suggestion="Filter")
def _():
    """Lookups are filtered."""
    return [(F.col("resource_type").isin(*FILTERED_DATA) & ~truthy("filter"), "Lookup has no filter")]


def _no_file(name):
    return F.coalesce(~F.bool_or(F.col("file_path").contains(name)), F.lit(True))


@rule("TF-STRUCTURE-001", "info", "best_practices", priority=5, scope="project_level", suggestion="Use the customary files")
def _():
    """Projects have the customary files."""
    return [(_no_file(f), f"No {f}") for f in ("main.tf", "variables.tf", "outputs.tf")]


@rule("TF-DOCS-001", "info", "best_practices", priority=5, scope="project_level", suggestion="Add a README")
def _():
    """Projects have a README."""
    return [(_no_file("README"), "No README")]


def _placeholder(rule_id, severity, category, priority):
    def checks():
        return [(F.bool_or(F.lit(False)), "Placeholder")]

    checks.__doc__ = "Kept for its id, never raised."
    rule(rule_id, severity, category, priority=priority, scope="project_level")(checks)


_placeholder("TF-STATE-001", "error", "security", 30)
_placeholder("TF-QUALITY-001", "warning", "best_practices", 10)
_placeholder("TF-QUALITY-002", "error", "syntax", 40)
