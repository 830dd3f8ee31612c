"""Credentials of remote file systems as Hadoop options, and a probe."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class CloudCredentialError(RuntimeError):
    """A remote location cannot be read with the credentials given."""


@dataclass
class CloudOptions:
    """Keys for s3, gs, az and http locations. `token_command` is run for a bearer token; `extra` holds further
    `fs.*` options as they are."""

    s3_access_key: str | None = None
    s3_secret_key: str | None = None
    s3_session_token: str | None = None
    s3_endpoint: str | None = None
    gs_key_file: str | None = None
    az_account: str | None = None
    az_key: str | None = None
    token_command: list[str] | None = None
    anonymous: bool = False
    extra: dict[str, str] = field(default_factory=dict)

    def hadoop(self) -> dict[str, str]:
        """The option names of the Hadoop connectors."""
        out = {
            "fs.s3a.access.key": self.s3_access_key, "fs.s3a.secret.key": self.s3_secret_key, "fs.s3a.session.token": self.s3_session_token, "fs.s3a.endpoint": self.s3_endpoint,
            "fs.gs.auth.service.account.json.keyfile": self.gs_key_file,
            f"fs.azure.account.key.{self.az_account}.dfs.core.windows.net": self.az_key if self.az_account else None,
        }
        if self.anonymous:
            out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
            out["fs.gs.auth.type"] = "UNAUTHENTICATED"
        if self.token_command:
            try:
                out["fs.gs.auth.access.token"] = subprocess.run(self.token_command, capture_output=True, text=True, check=True, timeout=60).stdout.strip()
            except (OSError, subprocess.SubprocessError) as e:
                raise CloudCredentialError(f"the token command failed: {e}") from None
        return {k: v for k, v in out.items() if v} | self.extra

    def apply(self, spark: SparkSession) -> None:
        """Set the options for all reads of this session's application."""
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in self.hadoop().items():
            conf.set(k, v)


def check_cloud_access(spark: SparkSession, location: str, options: CloudOptions | None = None) -> int:
    """The number of entries at a location; CloudCredentialError with the reason where it cannot be listed."""
    from py4j.protocol import Py4JJavaError

    if options:
        options.apply(spark)
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(location)
        return len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))
    except Py4JJavaError as e:
        raise CloudCredentialError(f"{location}: {e.java_exception.getMessage()}") from None
