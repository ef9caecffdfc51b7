"""DataFrame -> DataFrame operators over unit x month panels."""
