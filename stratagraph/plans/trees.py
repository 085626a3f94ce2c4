"""A small configuration tree, written from the tables of nations and regions, for queries of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from .star import table
from .storage import shared_dir

_HEAD = """terraform {
  required_version = ">= 1.5"
  required_providers {
    aws = { source = "hashicorp/aws", version = "~> 5.0" }
  }
  backend "s3" {
    bucket = "state"
  }
}
provider "aws" {
  region = "eu-west-1"
}
"""
#: Of a nation, in the file of its region.
_BLOCKS = """variable "v{n}" {{
  type    = string
  default = "{name}"
}}
resource "aws_vpc" "n{n}" {{
  cidr_block = var.v{n}
  name       = "${{local.l{n}}}"
  tags       = {{ Name = "{name}", Region = "{k}" }}
}}
locals {{
  l{n} = "x-${{var.v{n}}}"
  nested{n} = {{ a = [1, {n}], b = {{ c = "{name}" }} }}
}}
output "o{n}" {{
  value       = aws_vpc.n{n}.id
  description = "of {name}"
}}
data "aws_ami" "d{n}" {{
  owners = [local.l{n}]
}}
module "m{n}" {{
  source = "git::https://example.org/m{n}.git"
  input  = data.aws_ami.d{n}.id
}}
"""
_JSON = '{"resource": {"google_compute_network": {"g0": {"routing_mode": "GLOBAL"}}}}'

#: The nations with the line before their blocks.
NATIONS_SQL = "with recursive t as (select n_nationkey as n, n_name as name, n_regionkey as k, 24 * (row_number() over (partition by n_regionkey order by n_nationkey) - 1) as pos from nation)"
OBJECTS_SQL = NATIONS_SQL + """, objects as (
 select 'var.v' || n as full_name, 'variable' as type, 'v' || n as name, cast(null as varchar) as resource_type, 'r' || k || '.tf' as file, pos + 1 as line from t
 union all select 'aws_vpc.n' || n, 'resource', 'n' || n, 'aws_vpc', 'r' || k || '.tf', pos + 5 from t
 union all select 'local.l' || n, 'local', 'l' || n, null, 'r' || k || '.tf', pos + 10 from t
 union all select 'local.nested' || n, 'local', 'nested' || n, null, 'r' || k || '.tf', pos + 10 from t
 union all select 'output.o' || n, 'output', 'o' || n, null, 'r' || k || '.tf', pos + 14 from t
 union all select 'data.aws_ami.d' || n, 'data', 'd' || n, 'aws_ami', 'r' || k || '.tf', pos + 18 from t
 union all select 'module.m' || n, 'module', 'm' || n, null, 'r' || k || '.tf', pos + 21 from t
 union all select 'terraform.block_0', 'terraform', 'terraform', null, 'providers.tf', 1
 union all select 'provider.aws', 'provider', 'aws', null, 'providers.tf', 10
 union all select 'google_compute_network.g0', 'resource', 'g0', 'google_compute_network', 'more.tf.json', 1),
edges as (
 select 'aws_vpc.n' || n as src, 'var.v' || n as dst from t union all select 'aws_vpc.n' || n, 'local.l' || n from t union all select 'aws_vpc.n' || n, 'provider.aws' from t
 union all select 'local.l' || n, 'var.v' || n from t union all select 'output.o' || n, 'aws_vpc.n' || n from t union all select 'data.aws_ami.d' || n, 'local.l' || n from t union all select 'data.aws_ami.d' || n, 'provider.aws' from t
 union all select 'module.m' || a.n, 'data.aws_ami.d' || b.n from t a, t b)"""


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file where Spark's readers find it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def tree(spark: SparkSession, d: str) -> str:
    """The folder of a tree with a file for each region, and blocks for each of the 25 nations."""
    path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    files = {"providers.tf": _HEAD, "sub/more.tf.json": _JSON, "notes.txt": "no configuration"}
    variables = []
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        name = f"r{r.n_regionkey}.tf"
        files[name] = files.get(name, "") + _BLOCKS.format(n=r.n_nationkey, name=r.n_name, k=r.n_regionkey)
        variables.append(f'v{r.n_nationkey} = "{r.n_name}-dev"')
    files["dev.tfvars"] = "\n".join([*variables, "sizes = [1, 2]", ""])
    for name, text in files.items():
        put(spark, f"{path}/{name}", text)
    return path
