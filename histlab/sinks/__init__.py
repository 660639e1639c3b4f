"""Writers of reports and exports."""
