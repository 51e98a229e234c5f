import pytest

from logweave.functions.fields import strip_name

NAMES = {
    "access.log": "access",
    "access.log.1": "access",
    "access.log.2.gz": "access",
    "app-2023-10-27.log": "app",
    "server_2023-10-27.log": "server",
    "my-app-1.0.0.log": "my-app",
    "service-v2.log": "service",
    "audit.log.2023-10-27.txt": "audit",
    "app-v20240101": "app-v",
    "node-1.log": "node",
    "log4j2.log": "log4j",
    "2024-01-01.log": "2024-01-01.log",
    "UPPER.LOG.GZ": "UPPER",
    "trail-_.log": "trail",
    "": "",
}


@pytest.mark.parametrize("name", NAMES)
def test_application_names(name):
    assert strip_name(name) == NAMES[name]
