"""Every operator and flow of ``incidentlab`` as a query over the TPC-H-like test tables,
each with the SQL that states the expected result."""
