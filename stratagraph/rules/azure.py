"""Rules for Azure resources."""

from pyspark.sql import functions as F

from .registry import attr, falsy, items, number, numeric, registry, tag_keys, truthy

rule = registry.rule
# Longest names by type, others 64; types with a character rule; generic names; regions.
NAME_LIMITS = {
    "azurerm_storage_account": 24, "azurerm_virtual_machine": 15, "azurerm_resource_group": 90, "azurerm_virtual_network": 64, "azurerm_subnet": 80,
    "azurerm_network_interface": 80, "azurerm_public_ip": 80, "azurerm_network_security_group": 80, "azurerm_key_vault": 24, "azurerm_sql_server": 63,
    "azurerm_sql_database": 128, "azurerm_app_service": 60, "azurerm_app_service_plan": 40, "azurerm_container_registry": 50, "azurerm_kubernetes_cluster": 63,
}
GENERIC_NAMES = ("storage", "mystorage", "account", "sa", "storageaccount")
REGIONS = ("eastus", "westeurope", "canadacentral", "australiaeast")
GOVERNANCE = ("confidentiality", "compliance", "owner", "data-classification")
PUBLIC = ("*", "0.0.0.0/0", "Internet")


def _name():
    """The cloud's name, not the block's label; empty where none is set."""
    return F.coalesce(attr("name"), F.lit(""))


@rule("AZURE-NAMING-001", "error", "naming", scope="generic", suggestion="Shorten the name")
def _():
    """Names fit their type's limit."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NAME_LIMITS.items() for x in kv)), F.col("resource_type")), F.lit(64))
    return [(F.length(_name()) > limit, F.concat(F.lit("Name is longer than "), limit.cast("string")))]


@rule("AZURE-NAMING-002", "error", "naming", *NAME_LIMITS, suggestion="Use allowed characters")
def _():
    """Names have allowed characters only."""
    storage = F.col("resource_type") == "azurerm_storage_account"
    ok = F.when(storage, _name().rlike("^[a-z0-9]+$")).otherwise(_name().rlike("^[A-Za-z0-9_-]+$"))
    return [((_name() != "") & ~_name().contains("${") & ~ok, "Name has characters that are not allowed")]


@rule("AZURE-NAMING-003", "error", "naming", scope="generic", suggestion="Remove the hyphen")
def _():
    """Names don't start or end with a hyphen."""
    return [(_name().startswith("-") | _name().endswith("-"), "Name starts or ends with a hyphen")]


@rule("AZURE-NAMING-004", "warning", "naming", scope="generic", suggestion="Use one hyphen")
def _():
    """No double hyphens."""
    return [(_name().contains("--"), "Name has a double hyphen")]


@rule("AZURE-NAMING-101", "error", "naming", "azurerm_storage_account", suggestion="3 to 24 lower-case letters and digits")
def _():
    """Storage account names follow the service's form."""
    return [(~F.length(_name()).between(3, 24), "Name is not of 3 to 24 characters"), (~_name().rlike("^[a-z0-9]+$"), "Name is not lower-case alphanumeric")]


@rule("AZURE-NAMING-102", "warning", "naming", "azurerm_storage_account", suggestion="Say what it stores")
def _():
    """Storage accounts have telling names."""
    return [(F.lower(_name()).isin(*GENERIC_NAMES), "Name is generic")]


@rule("AZURE-NAMING-201", "error", "naming", "azurerm_virtual_machine", suggestion="15 characters at most")
def _():
    """Machine names fit NetBIOS."""
    return [(F.length(_name()) > 15, "Name is longer than 15")]


@rule("AZURE-NAMING-202", "warning", "naming", "azurerm_virtual_machine", suggestion="Use parts with hyphens")
def _():
    """Machine names have parts."""
    return [(~_name().contains("-"), "Name has no hyphen")]


@rule("AZURE-NAMING-301", "warning", "naming", "azurerm_virtual_network", suggestion="Start with vnet-")
def _():
    """Networks are named by kind."""
    return [(~_name().startswith("vnet-"), "Name doesn't start with vnet-")]


@rule("AZURE-SECURITY-001", "error", "security", "azurerm_virtual_machine", suggestion="Encrypt the disks")
def _():
    """Machine disks are encrypted."""
    image = F.exists(items("storage_image_reference", "type:string"), lambda x: F.coalesce(x["type"] == "AzureDiskEncryption", F.lit(False)))
    data = F.exists(items("storage_data_disk", "encryption_settings:string"), lambda d: ~F.coalesce(d["encryption_settings"], F.lit("")).isin("", "[]", "{}", "false"))
    return [(~image & falsy("storage_os_disk.encryption_settings") & ~data, "Disks are not encrypted")]


def _identity():
    return [(falsy("identity") | (F.coalesce(attr("identity.type"), F.lit("")) == "None"), "No managed identity")]


@rule("AZURE-SECURITY-002", "warning", "security", "azurerm_virtual_machine", suggestion="Add a managed identity")
def _():
    """Machines have a managed identity."""
    return _identity()


@rule("AZURE-SECURITY-003", "warning", "security", "azurerm_virtual_machine")
def _():
    """Machines are patched; kept for its id, never raised."""
    return [(F.lit(False), "Patching")]


@rule("AZURE-SECURITY-004", "error", "security", "azurerm_virtual_machine", suggestion="Use keys")
def _():
    """Linux machines don't take passwords."""
    return [((F.lower(attr("storage_os_disk.os_type")) == "linux") & truthy("admin_password") & falsy("disable_password_authentication"), "Password login on Linux")]


_RULE = "access:string,direction:string,destination_port_range:string,source_address_prefix:string,destination_address_prefix:string,priority:double"


def _open(port):
    hit = F.exists(items("security_rule", _RULE), lambda r: (r["destination_port_range"] == port) & (r["access"] == "Allow") & (r["direction"] == "Inbound") & r["source_address_prefix"].isin(*PUBLIC))
    return [(hit, f"Port {port} is open to everyone")]


@rule("AZURE-SECURITY-101", "error", "security", "azurerm_network_security_group", suggestion="Restrict the sources")
def _():
    """SSH is not open to everyone."""
    return _open("22")


@rule("AZURE-SECURITY-102", "error", "security", "azurerm_network_security_group", suggestion="Restrict the sources")
def _():
    """RDP is not open to everyone."""
    return _open("3389")


@rule("AZURE-SECURITY-103", "warning", "security", "azurerm_network_security_group", suggestion="Deny the rest")
def _():
    """Groups end with a rule that denies the rest."""
    every = ("*", "0.0.0.0/0")
    hit = F.exists(items("security_rule", _RULE), lambda r: (r["access"] == "Deny") & r["source_address_prefix"].isin(*every) & r["destination_address_prefix"].isin(*every) & (F.coalesce(r["priority"], F.lit(0.0)) > 4000))
    return [(~hit, "No rule denies the rest")]


def _simple(rule_id, severity, kind, path, message):
    def checks():
        return [(falsy(path), message)]

    checks.__doc__ = f"{kind} sets {path}."
    rule(rule_id, severity, "security", kind, suggestion=f"Set {path}")(checks)


_simple("AZURE-SECURITY-104", "error", "azurerm_subnet", "network_security_group_id", "Subnet has no security group")
_simple("AZURE-SECURITY-105", "warning", "azurerm_virtual_network", "ddos_protection_plan.enable", "No DDoS protection")
_simple("AZURE-SECURITY-201", "error", "azurerm_storage_account", "enable_https_traffic_only", "Plain HTTP is allowed")
_simple("AZURE-SECURITY-204", "warning", "azurerm_storage_account", "encryption.infrastructure_encryption_enabled", "No infrastructure encryption")
_simple("AZURE-SECURITY-304", "warning", "azurerm_sql_server", "extended_auditing_policy", "No auditing")
_simple("AZURE-SECURITY-402", "warning", "azurerm_key_vault", "purge_protection_enabled", "No purge protection")
_simple("AZURE-SECURITY-403", "error", "azurerm_key_vault", "soft_delete_enabled", "No soft delete")
_simple("AZURE-SECURITY-501", "error", "azurerm_app_service", "https_only", "Plain HTTP is allowed")
_simple("AZURE-SECURITY-601", "error", "azurerm_kubernetes_cluster", "role_based_access_control_enabled", "No role-based access control")
_simple("AZURE-SECURITY-602", "warning", "azurerm_kubernetes_cluster", "api_server_authorized_ip_ranges", "API server is open to every address")


def _encrypted(block):
    return [(falsy(block) | ~F.coalesce(attr(f"{block}.enabled", "boolean"), F.lit(True)), f"No {block.replace('_', ' ')}")]


@rule("AZURE-SECURITY-202", "error", "security", "azurerm_storage_account", suggestion="Encrypt")
def _():
    """Storage is encrypted."""
    return _encrypted("encryption")


def _allows(block):
    return [(F.coalesce(attr(f"{block}.default_action"), F.lit("Allow")) == "Allow", "Network access is allowed by default")]


@rule("AZURE-SECURITY-203", "warning", "security", "azurerm_storage_account", suggestion="Deny by default")
def _():
    """Storage denies networks by default."""
    return _allows("network_rules")


def _old_tls(path):
    return [(F.coalesce(attr(path), F.lit("1.0")).isin("1.0", "1.1"), "TLS before 1.2 is allowed")]


@rule("AZURE-SECURITY-301", "error", "security", "azurerm_sql_server", suggestion="Require TLS 1.2")
def _():
    """Database servers require TLS 1.2."""
    return _old_tls("minimal_tls_version")


@rule("AZURE-SECURITY-302", "error", "security", "azurerm_sql_database", suggestion="Encrypt")
def _():
    """Databases are encrypted."""
    return _encrypted("transparent_data_encryption")


@rule("AZURE-SECURITY-303", "warning", "security", "azurerm_sql_firewall_rule", suggestion="Restrict the range")
def _():
    """Database firewalls don't admit every address."""
    start, end = attr("start_ip_address"), attr("end_ip_address")
    return [((start == "0.0.0.0") & (end == "255.255.255.255"), "Every address is admitted")]  # noqa: S104


@rule("AZURE-SECURITY-401", "warning", "security", "azurerm_key_vault", suggestion="Deny by default")
def _():
    """Vaults deny networks by default."""
    return _allows("network_acls")


@rule("AZURE-SECURITY-502", "error", "security", "azurerm_app_service", suggestion="Require TLS 1.2")
def _():
    """Apps require TLS 1.2."""
    return _old_tls("min_tls_version")


@rule("AZURE-SECURITY-503", "warning", "security", "azurerm_app_service", suggestion="Add a managed identity")
def _():
    """Apps have a managed identity."""
    return _identity()


@rule("AZURE-SECURITY-701", "warning", "security", "azurerm_key_vault", "azurerm_sql_server", "azurerm_storage_account", "azurerm_virtual_machine", scope="generic")
def _():
    """Diagnostics are kept; kept for its id, never raised."""
    return [(F.lit(False), "Diagnostics")]


@rule("AZURE-SECURITY-702", "warning", "security", "azurerm_log_analytics_workspace", suggestion="Keep logs for a year")
def _():
    """Logs are kept for a year."""
    return numeric("retention_in_days", [(number("retention_in_days", 0) < 365, "Logs are kept for less than a year")])


@rule("AZURE-SECURITY-801", "warning", "security", "azurerm_role_assignment", suggestion="Grant less")
def _():
    """Roles are narrow."""
    return [(attr("role_definition_name").rlike("Owner|Contributor|User Access Administrator"), "A broad role is granted")]


@rule("AZURE-SECURITY-901", "warning", "security", scope="generic", suggestion="Add the tags")
def _():
    """Resources carry governance tags."""
    lack = F.array_except(F.array(*map(F.lit, GOVERNANCE)), tag_keys())
    return [(F.size(lack) > 0, F.concat(F.lit("Missing tags: "), F.array_join(lack, ", ")))]


@rule("AZURE-SECURITY-902", "warning", "security", scope="generic", suggestion="Use an approved region")
def _():
    """Resources are in approved regions."""
    return [(~F.lower(F.coalesce(attr("location"), F.lit(""))).isin(*REGIONS), "Region is not approved")]
