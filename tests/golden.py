"""A recorded analysis of a sample project of 49 objects and 118 dependencies."""

# Name, kind, resource type, whether there is a default, names of the attributes (of resources, modules and
# outputs), source, explicit and implicit dependencies, missing references, state and its reason.
OBJECTS = [
    ('random_id.suffix', 'resource', 'random_id', False, ['byte_length'], None, [], [], [], 'leaf', 'Independent infrastructure used by 1 consumer(s)'),
    ('aws_vpc.main', 'resource', 'aws_vpc', False, ['cidr_block', 'tags'], None, [], ['local.network_config', 'local.computed_tags', 'provider.aws'], [], 'integrated', 'Infrastructure using 3 deps, used by 2 consumer(s)'),
    ('aws_subnet.main', 'resource', 'aws_subnet', False, ['availability_zone', 'cidr_block', 'count', 'tags', 'vpc_id'], None, [], ['aws_vpc.main', 'local.project_prefix', 'var.aws_region', 'local.computed_tags', 'local.network_config', 'provider.aws'], [], 'active', 'Core infrastructure using 6 dependencies'),
    ('aws_security_group.web', 'resource', 'aws_security_group', False, ['description', 'dynamic', 'egress', 'name', 'tags', 'vpc_id'], None, [], ['local.security_rules', 'local.computed_tags', 'aws_vpc.main', 'local.naming', 'provider.aws'], [], 'integrated', 'Infrastructure using 5 deps, used by 1 consumer(s)'),
    ('aws_instance.web', 'resource', 'aws_instance', False, ['ami', 'count', 'instance_market_options', 'instance_type', 'monitoring', 'root_block_device', 'subnet_id', 'tags', 'vpc_security_group_ids'], None, [], ['local.storage_config', 'var.instance_count', 'aws_security_group.web', 'var.enable_monitoring', 'local.computed_tags', 'local.naming', 'local.network_config', 'var.machine_size', 'local.derived_config', 'local.instance_sizes', 'provider.aws'], ['data.aws_ami', 'data.aws_ami.ubuntu'], 'missing_dependency', 'References 2 undefined object(s): data.aws_ami, data.aws_ami.ubuntu'),
    ('google_compute_network.vpc', 'resource', 'google_compute_network', False, ['auto_create_subnetworks', 'name'], None, [], ['local.naming', 'provider.google'], [], 'integrated', 'Infrastructure using 2 deps, used by 2 consumer(s)'),
    ('google_compute_subnetwork.subnet', 'resource', 'google_compute_subnetwork', False, ['count', 'ip_cidr_range', 'name', 'network', 'region'], None, [], ['google_compute_network.vpc', 'local.network_config', 'local.project_prefix', 'var.gcp_region', 'provider.google'], [], 'integrated', 'Infrastructure using 5 deps, used by 1 consumer(s)'),
    ('google_compute_instance.web', 'resource', 'google_compute_instance', False, ['boot_disk', 'count', 'labels', 'machine_type', 'name', 'network_interface', 'scheduling', 'zone'], None, [], ['local.storage_config', 'var.gcp_zone', 'var.instance_count', 'local.naming', 'local.computed_tags', 'local.network_config', 'var.machine_size', 'local.derived_config', 'local.instance_sizes', 'provider.google'], [], 'active', 'Infrastructure resource using 10 dependencies'),
    ('azurerm_resource_group.main', 'resource', 'azurerm_resource_group', False, ['location', 'name', 'tags'], None, [], ['var.azure_region', 'local.computed_tags', 'local.naming', 'provider.azurerm'], [], 'integrated', 'Infrastructure using 4 deps, used by 4 consumer(s)'),
    ('azurerm_virtual_network.main', 'resource', 'azurerm_virtual_network', False, ['address_space', 'location', 'name', 'resource_group_name', 'tags'], None, [], ['local.network_config', 'local.computed_tags', 'local.naming', 'azurerm_resource_group.main', 'provider.azurerm'], [], 'integrated', 'Infrastructure using 5 deps, used by 1 consumer(s)'),
    ('azurerm_subnet.internal', 'resource', 'azurerm_subnet', False, ['address_prefixes', 'count', 'name', 'resource_group_name', 'virtual_network_name'], None, [], ['local.network_config', 'local.project_prefix', 'azurerm_resource_group.main', 'azurerm_virtual_network.main', 'provider.azurerm'], [], 'active', 'Core infrastructure using 5 dependencies'),
    ('azurerm_network_interface.main', 'resource', 'azurerm_network_interface', False, ['count', 'ip_configuration', 'location', 'name', 'resource_group_name', 'tags'], None, [], ['var.instance_count', 'local.computed_tags', 'local.naming', 'azurerm_resource_group.main', 'local.network_config', 'provider.azurerm'], [], 'active', 'Core infrastructure using 6 dependencies'),
    ('azurerm_linux_virtual_machine.main', 'resource', 'azurerm_linux_virtual_machine', False, ['admin_ssh_key', 'admin_username', 'count', 'location', 'name', 'network_interface_ids', 'os_disk', 'resource_group_name', 'size', 'source_image_reference', 'tags'], None, [], ['local.storage_config', 'var.instance_count', 'local.naming', 'local.computed_tags', 'azurerm_resource_group.main', 'var.machine_size', 'local.instance_sizes', 'provider.azurerm'], [], 'active', 'Infrastructure resource using 8 dependencies'),
    ('var.environment', 'variable', None, False, [], None, [], [], [], 'input', 'Input variable used by 5 object(s)'),
    ('var.machine_size', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 5 object(s)'),
    ('var.instance_count', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 9 object(s)'),
    ('var.enable_monitoring', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 7 object(s)'),
    ('var.tags', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 1 object(s)'),
    ('var.aws_region', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 2 object(s)'),
    ('var.gcp_region', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 3 object(s)'),
    ('var.gcp_zone', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 2 object(s)'),
    ('var.azure_region', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 1 object(s)'),
    ('var.azure_subscription_id', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 1 object(s)'),
    ('var.azure_tenant_id', 'variable', None, True, [], None, [], [], [], 'input', 'Input variable used by 1 object(s)'),
    ('var.unused_variable', 'variable', None, True, [], None, [], [], [], 'unused', 'Variable declared with default but never used in infrastructure'),
    ('output.locals_debug', 'output', None, False, ['description', 'value'], None, [], ['local.debug_info'], [], 'orphaned', 'Output references 1 intermediate value(s) but may not be useful externally'),
    ('output.naming_conventions', 'output', None, False, ['description', 'value'], None, [], ['local.naming'], [], 'orphaned', 'Output references 1 intermediate value(s) but may not be useful externally'),
    ('output.derived_configurations', 'output', None, False, ['description', 'value'], None, [], ['local.derived_config'], [], 'orphaned', 'Output references 1 intermediate value(s) but may not be useful externally'),
    ('output.network_configuration', 'output', None, False, ['description', 'value'], None, [], ['local.network_config'], [], 'orphaned', 'Output references 1 intermediate value(s) but may not be useful externally'),
    ('output.aws_instances', 'output', None, False, ['description', 'value'], None, [], ['local.derived_config', 'aws_instance.web', 'var.enable_monitoring'], [], 'output_interface', 'Exports infrastructure value (external interface) from 3 source(s)'),
    ('output.cross_cloud_summary', 'output', None, False, ['description', 'value'], None, [], ['local.security_rules', 'var.instance_count', 'var.environment', 'local.network_config', 'local.derived_config'], [], 'orphaned', 'Output references 5 intermediate value(s) but may not be useful externally'),
    ('output.google_compute_summary', 'output', None, False, ['description', 'value'], None, [], ['var.enable_monitoring'], [], 'orphaned', 'Output references 1 intermediate value(s) but may not be useful externally'),
    ('output.google_compute_network', 'output', None, False, ['description', 'value'], None, [], ['google_compute_network.vpc', 'local.network_config', 'google_compute_subnetwork.subnet', 'var.gcp_region'], [], 'output_interface', 'Exports infrastructure value (external interface) from 4 source(s)'),
    ('provider.aws', 'provider', None, False, [], None, [], ['var.aws_region'], [], 'configuration', 'Provider used by 4 resource(s)'),
    ('provider.google', 'provider', None, False, [], None, [], ['var.gcp_zone', 'var.gcp_region'], [], 'configuration', 'Provider used by 3 resource(s)'),
    ('provider.azurerm', 'provider', None, False, [], None, [], ['var.azure_tenant_id', 'var.azure_subscription_id'], [], 'configuration', 'Provider used by 5 resource(s)'),
    ('provider.tfe', 'provider', None, False, [], None, [], [], [], 'unused', 'Provider configured but no resources use it'),
    ('local.project_prefix', 'local', None, False, [], None, [], ['var.environment'], [], 'active', 'Computed local using 1 input(s), used by 5 component(s)'),
    ('local.naming', 'local', None, False, [], None, [], ['random_id.suffix', 'local.project_prefix'], [], 'active', 'Computed local using 2 input(s), used by 10 component(s)'),
    ('local.instance_sizes', 'local', None, False, [], None, [], [], [], 'active', 'Local value used by 4 infrastructure component(s)'),
    ('local.derived_config', 'local', None, False, [], None, [], ['var.enable_monitoring', 'var.environment', 'var.instance_count'], [], 'active', 'Computed local using 3 input(s), used by 7 component(s)'),
    ('local.network_config', 'local', None, False, [], None, [], ['var.instance_count'], [], 'active', 'Computed local using 1 input(s), used by 12 component(s)'),
    ('local.storage_config', 'local', None, False, [], None, [], [], [], 'active', 'Local value used by 3 infrastructure component(s)'),
    ('local.computed_tags', 'local', None, False, [], None, [], ['var.instance_count', 'var.environment', 'var.tags', 'var.enable_monitoring', 'var.machine_size', 'local.derived_config'], [], 'active', 'Computed local using 6 input(s), used by 9 component(s)'),
    ('local.security_rules', 'local', None, False, [], None, [], ['var.enable_monitoring'], [], 'active', 'Computed local using 1 input(s), used by 3 component(s)'),
    ('local.debug_info', 'local', None, False, [], None, [], ['local.security_rules', 'var.instance_count', 'var.environment', 'local.project_prefix', 'var.enable_monitoring', 'local.naming', 'local.network_config', 'var.machine_size', 'local.derived_config', 'local.instance_sizes'], [], 'active', 'Computed local using 10 input(s), used by 1 component(s)'),
    ('local.unused_calculation', 'local', None, False, [], None, [], ['var.unused_variable'], [], 'unused', 'Local value with 1 input(s) but not used in infrastructure'),
    ('local.unused_circular_reference', 'local', None, False, [], None, [], ['local.unused_calculation'], [], 'unused', 'Local value with 1 input(s) but not used in infrastructure'),
    ('terraform.block_0', 'terraform', None, False, [], None, [], [], [], 'configuration', 'Terraform configuration block'),
]
STATES = {'active': 14, 'unused': 4, 'leaf': 1, 'integrated': 6, 'missing_dependency': 1, 'orphaned': 6, 'output_interface': 2, 'configuration': 4, 'input': 11}
TYPES = {'random_id': 1, 'aws_vpc': 1, 'aws_subnet': 1, 'aws_security_group': 1, 'aws_instance': 1, 'google_compute_network': 1, 'google_compute_subnetwork': 1, 'google_compute_instance': 1, 'azurerm_resource_group': 1, 'azurerm_virtual_network': 1, 'azurerm_subnet': 1, 'azurerm_network_interface': 1, 'azurerm_linux_virtual_machine': 1}
COUNTS = {'resources': 13, 'data_sources': 0, 'modules': 0, 'variables': 12, 'outputs': 8, 'providers': 4, 'locals': 11, 'total': 48}
SCORE = 62.08
