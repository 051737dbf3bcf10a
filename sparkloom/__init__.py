"""sparkloom: graph analytics and result analytics expressed as Spark plans."""
