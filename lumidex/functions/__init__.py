"""Part of lumidex; see the package README section of the same name."""
