"""JDBC (S8) without a database: options and the whitelist check."""

import pytest

from hirelake.sources.jdbc import jdbc_properties, read_jdbc_table


def test_properties_pass_ssl_settings_through():
    props = jdbc_properties(user="u", password="p", sslmode="verify-full", sslrootcert="/ca.pem")
    assert props == {"fetchsize": "10000", "user": "u", "password": "p",
                     "sslmode": "verify-full", "sslrootcert": "/ca.pem"}
    assert "sslmode" not in jdbc_properties(user="u")


def test_unknown_table_fails_before_connecting(spark):
    with pytest.raises(ValueError):
        read_jdbc_table(spark, "jdbc:postgresql://nowhere/db", "pg_user", {}, lower=1, upper=2)
