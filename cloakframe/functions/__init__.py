"""Part of cloakframe."""
